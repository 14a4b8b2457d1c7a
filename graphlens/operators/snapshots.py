"""What changed between consecutive full snapshots: Merkle digests over hash ranges of the keys.

Keys are hashed; the leading bits of the hash name a leaf. Rows move once, to (repo, leaf): there they are reduced to one
per path and snapshot, digested, and later diffed. A leaf's digest is the exclusive or over its rows, so that it aggregates in
any order; digests of inner nodes are that of their children. One row per snapshot holds its tree of digests; two snapshots are
compared from the root down, each level only below nodes that differ, and rows are diffed only within leaves that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.tables import cut

#: Bits of the key's hash that each level of the tree adds; the last entry is the depth of the leaves.
LEVELS = (0, 4, 8, 12)
#: The shortest beginning of a commit hash that names a commit.
SHORTEST = 4
#: Names of commits up to which their table is broadcast; a larger one is joined by a shuffle of the rows.
MOST_BROADCAST = 100_000


def plain_path(path: Column) -> Column:
    """Forward slashes, single, no leading `/` or `./`, no outer blanks; an empty result is null."""
    p = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    p = F.trim(F.regexp_replace(p, r"^(?:\.?/)+", ""))
    return F.when(p != "", p)


def plain_hash(value: Column) -> Column:
    """Lower case, no outer blanks, no `sha1:`; a blank one is null."""
    h = F.trim(F.regexp_replace(F.lower(F.trim(value)), "^sha1:", ""))
    return F.when(h != "", h)


def plain_branch(branch: Column) -> Column:
    return F.regexp_replace(F.trim(branch), "^refs/heads/", "")


def commit_names(repos: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, name, commit_hash): the commit that each name in `files` stands for, in full or by its beginning.

    A name that is shorter than SHORTEST, unknown, or the beginning of several commits (and none in full) has no row.
    """
    names = files.select("repo_id", F.lower(F.trim("commit_hash")).alias("name")).filter(F.length("name") >= SHORTEST).distinct()
    known = repos.select("repo_id", "commit_hash").filter(F.length(F.trim("commit_hash")) >= SHORTEST).distinct()
    known = known.groupBy("repo_id", F.lower(F.trim("commit_hash")).alias("full")).agg(F.min("commit_hash").alias("commit_hash"))
    head = lambda c: F.substring(c, 1, SHORTEST).alias("head")
    both = names.withColumn("head", head("name")).join(known.withColumn("head", head("full")), ["repo_id", "head"]).filter(F.col("full").startswith(F.col("name")))
    found = both.groupBy("repo_id", "name").agg(
        F.count("*").alias("n"), F.max("commit_hash").alias("one"), F.max(F.when(F.col("full") == F.col("name"), F.col("commit_hash"))).alias("exact")
    )
    return found.filter("exact is not null or n = 1").select("repo_id", "name", F.coalesce("exact", "one").alias("commit_hash"))


def consecutive(repos: DataFrame, present: DataFrame) -> DataFrame:
    """(repo_id, new, old): each snapshot but a branch's first with the one before it in the same repo and branch.

    A snapshot's time is its earliest scan (ties in order: by commit), its branch that of its earliest scan.
    """
    scans = repos.join(present, ["repo_id", "commit_hash"], "left_semi")
    first = scans.groupBy("repo_id", "commit_hash").agg(F.min("scan_time").alias("at"), F.min_by(F.coalesce(plain_branch(F.col("branch")), F.lit("")), F.struct("scan_time", "branch")).alias("branch"))
    before = Window.partitionBy("repo_id", "branch").orderBy("at", "commit_hash")
    return first.select("repo_id", F.col("commit_hash").alias("new"), F.lag("commit_hash").over(before).alias("old")).filter("old is not null")


def snapshot_names(repos: DataFrame, files: DataFrame) -> DataFrame:
    """(repo_id, name, commit_hash, snapshot, next): for each name of a commit in `files` the number of its snapshot and of the
    one after it in the branch (null: none)."""
    names = commit_names(repos, files)
    number = lambda c: F.xxhash64("repo_id", c)
    after = consecutive(repos, names.select("repo_id", "commit_hash").distinct()).select("repo_id", F.col("old").alias("commit_hash"), number("new").alias("next"))
    return names.join(after, ["repo_id", "commit_hash"], "left").select("repo_id", "name", "commit_hash", number("commit_hash").alias("snapshot"), "next")


def trees(digests: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(repo_id, snapshot, digest, below): one row per snapshot out of (repo_id, snapshot, leaf, digest); `below` nests the nodes
    (node, digest, below) of each level down to the leaves (node, digest)."""
    nodes = digests.repartition("repo_id", "snapshot").select("repo_id", "snapshot", F.col("leaf").alias("node"), "digest")
    for above, bits in reversed(list(zip(levels, levels[1:]))):
        child = F.struct(*[c for c in nodes.columns if c not in ("repo_id", "snapshot")])
        up = F.shiftright("node", bits - above).alias("node")
        nodes = nodes.select("repo_id", "snapshot", up, "digest", child.alias("child")).groupBy("repo_id", "snapshot", "node").agg(F.bit_xor("digest").alias("digest"), F.collect_list("child").alias("below"))
    return nodes.drop("node")


def differing_leaves(trees: DataFrame, pairs: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(repo_id, new, leaf) whose digests differ, for each pair (repo_id, new, old) of snapshots, found from the root down."""
    new = trees.select("repo_id", F.col("snapshot").alias("new"), F.col("digest").alias("d_new"), F.col("below").alias("b_new"))
    old = trees.select("repo_id", F.col("snapshot").alias("old"), F.col("digest").alias("d_old"), F.col("below").alias("b_old"))
    open_ = pairs.join(old, ["repo_id", "old"]).join(new, ["repo_id", "new"]).filter("d_new <> d_old").select("repo_id", "new", "b_new", "b_old")
    told = lambda x: F.transform(x, lambda e: F.struct(e["node"], e["digest"]))
    inside = lambda x: F.flatten(F.transform(F.filter(x, lambda e: e["node"] == F.col("node")), lambda e: e["below"])).alias(x)
    for k in range(1, len(levels)):
        a, b = told("b_new"), told("b_old")
        differ = F.array_distinct(F.transform(F.concat(F.array_except(a, b), F.array_except(b, a)), lambda e: e["node"]))
        open_ = open_.select("repo_id", "new", F.explode(differ).alias("node"), "b_new", "b_old")
        if k < len(levels) - 1:
            open_ = open_.select("repo_id", "new", inside("b_new"), inside("b_old"))
    return open_.select("repo_id", "new", F.col("node").alias("leaf"))


def snapshot_changes(repos: DataFrame, files: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(repo_id, commit_hash, path, change) of every snapshot against the one before it in its repo and branch.

    change: `added` (only in the newer), `removed` (only in the older) or `changed` (in both, with different hashes; a
    null or blank hash on either side is no change). Of several rows of a path in a snapshot the last loaded counts (ties:
    greater hash; a null loaded_at is the earliest). Rows of unknown commits, and rows with a null repo_id, commit or path or
    a blank path, are ignored. Repeated rows count once. Empty tables give an empty result; a branch's only snapshot gives no
    row. Other columns are ignored.
    """
    leaf = F.shiftrightunsigned(F.xxhash64("path"), 64 - levels[-1]).cast("int").alias("leaf")
    rows = files.select("repo_id", F.lower(F.trim("commit_hash")).alias("name"), plain_path(F.col("path")).alias("path"), plain_hash(F.col("content_hash")).alias("hash"), "loaded_at").filter("path is not null")
    names = cut(snapshot_names(repos, rows.withColumnRenamed("name", "commit_hash")), "snapshot-names")
    few = names.count() <= MOST_BROADCAST
    # (said here once, so that both readers of the placed rows ask the same of them and share one exchange)
    known = names.select("repo_id", "name", "snapshot", "next").filter("repo_id is not null and snapshot is not null")
    last = F.struct(F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp")).alias("at"), "hash").alias("last")
    placed = rows.join(F.broadcast(known) if few else known, ["repo_id", "name"]).select("repo_id", leaf, "snapshot", "next", "path", last).repartition("repo_id", "leaf")
    states = placed.groupBy("repo_id", "leaf", "snapshot", "next", "path").agg(F.max("last").alias("last")).select("repo_id", "leaf", "snapshot", "next", "path", "last.hash")
    digests = states.groupBy("repo_id", "leaf", "snapshot").agg(F.bit_xor(F.xxhash64("path", F.coalesce("hash", F.lit("")))).alias("digest"))
    pairs = known.filter("next is not null").select("repo_id", F.col("snapshot").alias("old"), F.col("next").alias("new")).distinct()
    leaves = differing_leaves(trees(digests, levels), pairs, levels)
    open_ = leaves.groupBy("repo_id", "leaf").agg(F.collect_list("new").alias("pairs"))
    # a row stands on the newer side of its snapshot's pair and on the older side of the next one's
    near = states.join(open_, ["repo_id", "leaf"])
    of = lambda c, newer: F.when(F.array_contains("pairs", F.col(c)), F.struct(F.col(c).alias("pair"), F.lit(newer).alias("newer")))
    one = near.select("repo_id", "leaf", "path", "hash", F.inline(F.array_compact(F.array(of("snapshot", True), of("next", False)))))
    hashes = [F.max(F.when(F.col("newer") == newer, F.struct("hash"))).alias(name) for name, newer in (("now", True), ("was", False))]
    told = one.groupBy("repo_id", "leaf", "pair", "path").agg(*hashes)
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now.hash") != F.col("was.hash"), "changed")
    told = told.select("repo_id", "pair", "path", change.alias("change")).filter("change is not null")
    commits = names.select("repo_id", F.col("snapshot").alias("pair"), "commit_hash").distinct()
    return told.join(F.broadcast(commits) if few else commits, ["repo_id", "pair"]).select("repo_id", "commit_hash", "path", "change")
