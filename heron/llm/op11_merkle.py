"""Merkle manifest of a table: digests of rows, joined by runs into a tree for each source and one over the sources, with a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.llm.common import saved, small_side, table, written
from heron.operators.ranges import numbered

#: Neighbouring nodes that have one parent; rows of a level up to which it is one task.
FANOUT, FEW = 3, 20_000
#: The fields of a document that its leaf covers, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields: `-` for null, else the number of UTF-8 bytes, a colon and the value, so that no two rows read alike."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def tree_key(group: Column) -> Column:
    """A key that is never null and sorts as the group does: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def levels(nodes: DataFrame, fanout: int, payload: list[str]) -> list[DataFrame]:
    """Levels of parents, from the leaves' parents up, of every tree at once: (tree, at, n, many, kids, digest), each a checkpoint.

    nodes: (tree, at, n, digest, *payload), at counting from 0 within a tree of n nodes. A parent's place is that of its
    children divided by fanout; kids are its children in order, those of the first level with their payload; n is now
    the number of nodes of the tree in this level. A tree leaves when one node remains. A lone node (many = false)
    is its own parent.
    """
    out: list[DataFrame] = []
    while True:
        kid = F.struct("at", "digest", *(payload if not out else []))
        runs = nodes.groupBy("tree", F.floor(F.col("at") / fanout).alias("run")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(kid)).alias("kids"))
        joined = F.sha2(F.array_join("kids.digest", ""), 256)
        many = F.col("n") > 1
        level = saved(runs.select("tree", F.col("run").alias("at"), F.ceil(F.col("n") / fanout).alias("n"), many.alias("many"), "kids", F.when(many, joined).otherwise(F.col("kids")[0]["digest"]).alias("digest")))
        level = level.coalesce(1) if level.count() <= FEW else level
        out.append(level)
        nodes = level.where("n > 1").select("tree", "at", "n", "digest")
        if nodes.isEmpty():
            return out


def tops(grown: list[DataFrame]) -> DataFrame:
    """(tree, digest): what remains of each tree."""
    found = [x.where("n = 1").select("tree", "digest") for x in grown]
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def with_paths(grown: list[DataFrame], fanout: int, starts: DataFrame, carried: list[str], payload: list[str]) -> DataFrame:
    """(tree, digest, *payload, *carried, path): the leaves of `levels` with the siblings on their way up, from the top down.

    starts: (tree, *carried, path) of each tree. Level by level, children take their parent's path by a join on their
    place, and put their own siblings in front: those before and those after them, each joined to one string. The rows
    of a level are a fanout-th of those below, so all joins together are little more than the last one.
    """
    below: DataFrame | None = None
    for k in reversed(range(len(grown))):
        level = grown[k]
        columns = ["tree", "at", "many", "kids", *carried, "path"]
        here = level.where("n = 1").join(starts, "tree").select(*columns)
        if below is not None:
            here = here.unionByName(level.where("n > 1").join(below, ["tree", "at"]).select(*columns))
        digests = F.col("kids.digest")
        siblings = F.struct(F.array_join(F.slice(digests, F.lit(1), F.col("pos")), "").alias("before"), F.array_join(F.slice(digests, F.col("pos") + 2, F.lit(fanout)), "").alias("after"))
        path = F.when(F.col("many"), F.concat(F.array(siblings), "path")).otherwise(F.col("path"))
        each = here.select("*", F.posexplode("kids").alias("pos", "kid"))
        extra = [F.col(f"kid.{c}").alias(c) for c in payload] if k == 0 else []
        below = each.select("tree", (F.col("at") * fanout + F.col("pos")).alias("at"), F.col("kid.digest").alias("digest"), *extra, *carried, path.alias("path"))
    return below.drop("at")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of the siblings of a path in its order."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["before"], step["after"])), ""), 256)


def manifest(rows: DataFrame, payload: list[str], fanout: int = FANOUT) -> DataFrame:
    """(digest, *payload, subroot, root, path) for rows (tree, id, digest, *payload): a tree for each value of `tree`, and one over their tops.

    Leaves of a tree stand in the order of id, then digest, and are numbered by ranges; while a tree has several nodes,
    every `fanout` neighbours become the digest of theirs. path holds the siblings up to the root, `before` and `after`
    the node of each level. Rows without id come first, rows that repeat an id stand side by side, equal rows are equal
    leaves. The rows are read twice, so give written ones. A tree of any size is dealt to all tasks: neither the
    numbers nor the levels are made by tree. An empty table gives no rows.
    """
    placed, total = numbered(rows, "tree", "id", "digest")
    if not total:
        return rows.select("digest", *payload, F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path")).limit(0)
    trees = saved(placed.groupBy("tree").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    leaves = placed.join(small_side(trees), "tree").select("tree", (F.col("place") - F.col("first")).alias("at"), "n", "digest", *payload)
    grown = levels(leaves, fanout, payload)

    above, n = numbered(tops(grown), "tree")
    whole = levels(above.select(F.lit(0).alias("tree"), F.col("place").alias("at"), F.lit(n).cast("long").alias("n"), "digest", F.col("tree").alias("name")), fanout, ["name"])
    root = tops(whole).first()["digest"]
    start = rows.sparkSession.createDataFrame([(0, [])], "tree int, path array<struct<before:string,after:string>>")
    starts = saved(with_paths(whole, fanout, start, [], ["name"]).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "path"))
    return with_paths(grown, fanout, starts, ["subroot"], payload).select("digest", *payload, "subroot", F.lit(root).alias("root"), "path")


def leaves_of(docs: DataFrame, fields: list[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(tree, id, digest, changed): the leaf of each row, and the one that it had with the `changed` fields `where` that holds."""
    new = leaf_digest([(changed or {}).get(c, F.col(c)) for c in fields])
    digest = leaf_digest([F.col(c) for c in fields])
    return docs.select(tree_key(F.col(group_col)).alias("tree"), F.col(id_col).alias("id"), digest.alias("digest"), F.when(where, new).alias("changed") if changed else F.lit(None).cast("string").alias("changed"))


def audited(docs: DataFrame, fields: list[str] = FIELDS, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text", fanout: int = FANOUT) -> DataFrame:
    """A row for each row of docs: id, leaf, subroot, root, path, proof_sha256, folded_root, verified; every other row, by the checksum of its id, is tampered with.

    Tampering deletes the line feeds of the text; a row whose text has none, or is null, is as before and verifies, as
    does a row without id, which is left alone. folded_root is made of the tampered leaf and the untampered siblings.
    Fields may be null; a null and an empty one differ. Long texts are hashed whole. Ids and groups are of any type;
    repeated rows are leaves each. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    even = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    plain = {text_col: F.regexp_replace(F.col(text_col).cast("string"), "\n", "")}
    rows = written(leaves_of(docs, fields, id_col, group_col, plain, even))
    found = manifest(rows, ["id", "changed"], fanout).withColumn("folded_root", folded(F.coalesce("changed", "digest"), F.col("path")))
    return found.select("id", F.col("digest").alias("leaf"), "subroot", "root", "path", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 11."""
    return audited(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::VARCHAR) || ':' || {name}::VARCHAR, '-')"


_LEAF = " || ".join(_field(c) for c in FIELDS)
#: Trees by recursion over levels, then every row's way up by recursion over the runs that it stands in.
SQL = f"""
WITH RECURSIVE bits(i, k, x) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM bits WHERE k = 8),
c AS (SELECT *, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, x: xor(a // 256, t[(xor(a, x) & 255) + 1])) AS crc FROM documents, tab),
l AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS k, sha256({_LEAF}) AS leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256({_LEAF.replace('text::', "replace(text, chr(10), '')::")}) ELSE sha256({_LEAF}) END AS bad FROM c),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS w, count(*) OVER (PARTITION BY k) AS n FROM l),
up(k, v, w, n, d) AS (SELECT k, 0, w, n, leaf FROM p UNION ALL SELECT k, v + 1, w // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY w)) FROM up WHERE n > 1 GROUP BY k, v, w // 3, n),
s AS MATERIALIZED (SELECT k, d, row_number() OVER (ORDER BY k) - 1 AS w, count(*) OVER () AS n FROM up WHERE n = 1),
top(v, w, n, d) AS (SELECT 0, w, n, d FROM s UNION ALL SELECT v + 1, w // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY w)) FROM top WHERE n > 1 GROUP BY v, w // 3, n),
g AS MATERIALIZED (SELECT k, v, w // 3 AS run, list(d ORDER BY w) AS ds FROM up WHERE n > 1 GROUP BY k, v, w // 3),
h AS MATERIALIZED (SELECT v, w // 3 AS run, list(d ORDER BY w) AS ds FROM top WHERE n > 1 GROUP BY v, w // 3),
f(doc_id, k, leaf, v, w, node, proof) AS (SELECT doc_id, k, leaf, 0, w, bad, '' FROM p UNION ALL SELECT doc_id, f.k, leaf, f.v + 1, run, sha256(array_to_string(ds[1:w % 3], '') || node || array_to_string(ds[w % 3 + 2:], '')), proof || array_to_string(ds[1:w % 3], '') || array_to_string(ds[w % 3 + 2:], '') FROM f JOIN g ON g.k = f.k AND g.v = f.v AND g.run = w // 3),
e AS (SELECT f.doc_id, f.k, leaf, s.w AS w, node, proof, s.d AS subroot FROM f JOIN s USING (k) WHERE f.v = (SELECT max(v) FROM up WHERE up.k = f.k)),
r(doc_id, leaf, subroot, v, w, node, proof) AS (SELECT doc_id, leaf, subroot, 0, w, node, proof FROM e UNION ALL SELECT doc_id, leaf, subroot, r.v + 1, run, sha256(array_to_string(ds[1:w % 3], '') || node || array_to_string(ds[w % 3 + 2:], '')), proof || array_to_string(ds[1:w % 3], '') || array_to_string(ds[w % 3 + 2:], '') FROM r JOIN h ON h.v = r.v AND h.run = w // 3)
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = d AS verified FROM r, (SELECT d, v AS last FROM top WHERE n = 1) WHERE v = last
"""
