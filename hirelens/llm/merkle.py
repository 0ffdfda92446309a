"""Merkle manifest of a table: leaf digests, one tree per group, one tree over the groups.

Every row is a leaf, the SHA-256 of its fields with their lengths. Within a group leaves
stand in order of their id; their places come from range partitions, sorted side by side,
and the sums of the partitions before, so no group is ever in one task. A level then
equijoins its nodes with themselves on computed sibling places: ``place XOR 1`` in a
binary tree, ``first of the run + (slot + offset) mod arity`` for every offset otherwise.
Every row of the join has its siblings to its left and right; the rows in slot zero emit
the parents. Group roots, in order of the group, are the leaves of the upper tree.

Proofs come down the same way: a level joins its nodes with their parents' proofs on the
parent's place, so a proof step is written once for all leaves below it and a leaf ends with
all its steps. Every level is written to the shared folder and deleted when the proofs
no longer need it.

Defined cases: a null field counts as ``-``, an empty text as a value of no bytes; a null
id comes first, a null group is a group of its own, before all others; rows with the same id stand in
order of their leaf, and rows equal in all fields have equal leaves and places of their own; the
last run of a level may be short, and a node alone in its run is hashed again; a single
leaf is its group's root. An empty table has no rows and no root. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelens.llm.common import drop_staged, staged


def digest(value: Column) -> Column:
    """Lowercase hex SHA-256 of a string."""
    return F.sha2(value, 256)


def framed(fields: list[Column]) -> Column:
    """The fields one after the other, each as byte count, colon and value, or ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                      for t in texts])


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaves(docs: DataFrame, fields: list[str], id_col: str, group_col: str,
           changed: dict[str, Column] | None = None) -> DataFrame:
    """(id, grp, leaf, altered): a row's digest, and its digest with the ``changed`` fields instead.

    ``grp`` sorts as the group does, null first.
    """
    changed = changed or {}
    other = [changed.get(f, F.col(f)) for f in fields]
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), group.alias("grp"),
        F.unhex(digest(framed([F.col(f) for f in fields]))).alias("leaf"),
        F.unhex(digest(framed(other))).alias("altered"))


def places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0, in ``order`` within the group) and ``n`` (rows of the group).

    Equal rows are told apart by where they were read, so they spread over partitions too.
    """
    keys = [group, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    seen = staged(dealt.select(*rows.columns, F.spark_partition_id().alias("_part"),
                               F.monotonically_increasing_id().alias("_at")), "placed")
    by_group = Window.partitionBy(group)            # a group has one row per partition at most
    before = F.sum("_c").over(by_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = seen.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    spans = spans.select(group, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"),
                         F.sum("_c").over(by_group).alias("n"))
    out = staged(seen.join(spans, [group, "_part"]).select(
        *rows.columns, (F.col("_at") + F.col("_shift")).alias("place"), "n"), "places")
    drop_staged(seen)
    return out


@dataclass
class Tree:
    """Levels from the leaves up, and the top node (grp, height, d) of every group."""
    levels: list[DataFrame]
    tops: DataFrame
    arity: int


def _siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` with the digests of their run's other nodes, ``left`` and ``right`` of them."""
    slot = F.pmod(F.col("place"), F.lit(arity))
    out, none = nodes, F.lit("").cast("binary")
    left, right = [none], [none]
    for offset in range(1, arity):
        if arity == 2:
            wanted = F.col("place").bitwiseXOR(F.lit(1).cast("long"))
        else:
            wanted = F.col("place") - slot + F.pmod(slot + offset, F.lit(arity))
        other = nodes.select(F.col("grp").alias(f"_g{offset}"), F.col("place").alias(f"_p{offset}"),
                             F.col("d").alias(f"_d{offset}"))
        out = out.join(other, (F.col("grp") == F.col(f"_g{offset}")) & (wanted == F.col(f"_p{offset}")), "left")
        held = F.coalesce(F.col(f"_d{offset}"), none)
        wraps = slot + offset >= arity              # the sibling then stands before the node
        left.append(F.when(wraps, held).otherwise(none))
        right.append(F.when(wraps, none).otherwise(held))
    return out.select(*nodes.columns, F.concat(*left).alias("left"), F.concat(*right).alias("right"))


def climb(nodes: DataFrame, arity: int = 2) -> Tree:
    """The trees over ``nodes`` (grp, place, n, d and what else the lowest level keeps)."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    single = (F.col("n") == 1)
    tops = nodes.where(single).select("grp", F.lit(0).alias("height"), "d")
    levels: list[DataFrame] = []
    while most > 1:
        level = staged(_siblings(nodes.where(~single), arity), f"level{len(levels)}")
        levels.append(level)
        nodes = level.where(F.col("place") % arity == 0).select(
            "grp", F.floor(F.col("place") / arity).alias("place"), F.ceil(F.col("n") / arity).alias("n"),
            F.unhex(digest(_hex(F.concat("left", "d", "right")))).alias("d"))
        tops = tops.union(nodes.where(single).select("grp", F.lit(len(levels)).alias("height"), "d"))
        most = -(-most // arity)
    return Tree(levels, staged(tops, "tops"), arity)


def descend(tree: Tree, lowest: DataFrame, tops: DataFrame) -> DataFrame:
    """``lowest`` (the nodes the tree was built of) with their ``steps`` up and the other columns of ``tops``.

    ``tops`` has grp, height, steps (from the top on) and columns that hold for the whole group.
    """
    kept = [c for c in tops.columns if c not in ("grp", "height", "steps")]
    above: DataFrame | None = None
    for height in range(len(tree.levels) - 1, -1, -1):
        ended = tops.where(F.col("height") == height + 1).select(
            F.col("grp").alias("_g"), F.lit(0).cast("long").alias("_p"), "steps", *kept)
        parents = ended if above is None else above.select(
            F.col("grp").alias("_g"), F.col("place").alias("_p"), "steps", *kept).union(ended)
        level = tree.levels[height]
        own = [c for c in level.columns if c not in ("left", "right")]
        step = F.array(F.struct("left", "right"))
        at = (F.col("grp") == F.col("_g")) & (F.floor(F.col("place") / tree.arity) == F.col("_p"))
        proofs = level.join(parents, at).select(*own, F.concat(step, "steps").alias("steps"), *kept)
        if height:
            proofs = staged(proofs, f"proofs{height}")
            drop_staged(level)
            if above is not None:
                drop_staged(above)
        above = proofs
    alone = tops.where(F.col("height") == 0).select(F.col("grp").alias("_g"), "steps", *kept)
    single = lowest.where(F.col("n") == 1).join(alone, F.col("grp") == F.col("_g")).select(
        *lowest.columns, "steps", *kept)
    return single if above is None else above.select(*single.columns).union(single)


def fold(leaf: Column, steps: Column) -> Column:
    """The root (hex) that a leaf (hex) and its proof lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: digest(F.concat(_hex(s["left"]), acc, _hex(s["right"]))))


def proof_text(steps: Column) -> Column:
    """The digests of a proof as hex, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: _hex(F.concat(s["left"], s["right"]))), "")


def manifest(docs: DataFrame, fields: list[str], id_col: str, group_col: str,
             changed: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """One row per row of ``docs``: id, leaf, altered, subroot and root (hex) and the ``steps`` of its proof.

    ``changed`` gives fields of a row as someone else has them; ``altered`` is the leaf they
    make, to be folded with the original proof.
    """
    listed = staged(leaves(docs, fields, id_col, group_col, changed), "leaves")
    lowest = places(listed.withColumnRenamed("leaf", "d"), "grp", ["id", "d"])
    drop_staged(listed)
    groups = climb(lowest, arity)
    ranked = places(groups.tops.select(F.lit("").alias("all"), F.col("grp").alias("name"), "height", "d"),
                    "all", ["name"]).withColumnRenamed("all", "grp")
    upper = climb(ranked, arity)
    top = upper.tops.first()                        # one row: the root of all
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    over = descend(upper, ranked, upper.tops.select("grp", "height", none.alias("steps")))
    tops = staged(over.select(F.col("name").alias("grp"), "height", F.col("d").alias("subroot"), "steps"), "subroots")
    proofs = descend(groups, lowest, tops)
    return proofs.select(
        F.col("id").alias(id_col), _hex(F.col("d")).alias("leaf"), _hex(F.col("altered")).alias("altered"),
        _hex(F.col("subroot")).alias("subroot"), F.lit(top["d"].hex() if top else None).alias("root"), "steps")


#: Unsigned CRC-32 of a string of ASCII characters, bit by bit.
_CRC = """(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, len(s) + 1),
  lambda i: ascii(s[i])::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT))"""


def _sql_leaf(n_chars: str) -> str:
    field = "coalesce(concat(strlen({0}::VARCHAR), ':', {0}::VARCHAR), '-')"
    return "sha256(concat(" + ", ".join(field.format(f) for f in ("doc_id", "source", "lang", n_chars, "text")) + "))"


def _sql_tree(name: str, source: str) -> str:
    """CTE of all nodes (g, l, i, d, n) of the trees over ``source`` (g, i, d, n)."""
    return f"""{name}(g, l, i, d, n) AS (
  SELECT g, 0, i, d, n FROM {source}
  UNION ALL
  SELECT g, l + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1
  GROUP BY g, l, i // 2, n)"""


def _sql_path(name: str, source: str, tree: str) -> str:
    """CTE with a row per leaf and level: what the siblings say and the leaf folded so far."""
    return f"""{name}(g, leaf, l, i, n, proof, folded, up) AS (
  SELECT g, i, 0, i, n, proof, folded, d FROM {source}
  UNION ALL
  SELECT p.g, p.leaf, p.l + 1, p.i // 2, (p.n + 1) // 2, concat(p.proof, coalesce(s.d, '')),
         sha256(CASE WHEN p.i % 2 = 0 THEN concat(p.folded, coalesce(s.d, '')) ELSE concat(s.d, p.folded) END),
         p.up
  FROM {name} p LEFT JOIN {tree} s ON s.g = p.g AND s.l = p.l AND s.i = xor(p.i, 1)
  WHERE p.n > 1)"""


#: Rows of the manifest over documents, where a tampered row has one more character than it says.
ORACLE = f"""
WITH RECURSIVE crc AS (
  SELECT *, CASE WHEN {_CRC} % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS told
  FROM (SELECT *, doc_id::VARCHAR AS s FROM documents)),
lv AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_sql_leaf('n_chars')} AS d, {_sql_leaf('told')} AS altered FROM crc),
leafs AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i,
                 count(*) OVER (PARTITION BY g) AS n FROM lv),
{_sql_tree('tree', 'leafs')},
subs AS (SELECT '' AS g, g AS lang, d, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
{_sql_tree('upper_tree', 'subs')},
starts AS (SELECT g, i, n, '' AS proof, altered AS folded, d FROM leafs),
{_sql_path('path', 'starts', 'tree')},
low AS (SELECT p.g, p.leaf, p.proof, p.folded, s.i AS spot, s.n AS many, s.d AS subroot
        FROM path p JOIN subs s ON s.lang = p.g WHERE p.n = 1),
high(g, leaf, l, i, n, proof, folded, subroot) AS (
  SELECT g, leaf, 0, spot, many, proof, folded, subroot FROM low
  UNION ALL
  SELECT p.g, p.leaf, p.l + 1, p.i // 2, (p.n + 1) // 2, concat(p.proof, coalesce(s.d, '')),
         sha256(CASE WHEN p.i % 2 = 0 THEN concat(p.folded, coalesce(s.d, '')) ELSE concat(s.d, p.folded) END), p.subroot
  FROM high p LEFT JOIN upper_tree s ON s.l = p.l AND s.i = xor(p.i, 1) WHERE p.n > 1),
top AS (SELECT d AS root FROM upper_tree WHERE n = 1)
SELECT f.doc_id, f.d AS leaf, h.subroot, top.root, sha256(h.proof) AS proof_sha256,
       h.folded AS folded_root, h.folded = top.root AS verified
FROM high h JOIN leafs f ON f.g = h.g AND f.i = h.leaf, top WHERE h.n = 1
"""
