"""C4 split_tags, C5/C6 dictionary skill extraction, C12 tag alias, C13 skill count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelens import dims
from hirelens.functions.text import WS_CHARS, WS_CLASS, ustrip

# Separators: the fixed punctuation set plus any Unicode blank.
TAG_SPLIT = "[" + dims.TAG_SEPARATORS.replace("|", "\\|") + WS_CLASS + "]+"
SEPARATORS = dims.TAG_SEPARATORS + WS_CHARS


def tag_array(text: Column) -> Column:
    """Split a raw tag text into non-blank parts (array<string>, never null).

    Parts cannot contain a blank (blanks are separators), so dropping empty
    strings is all the per-part clean-up needed: no lambda. Every separator becomes
    a comma first, so the text is split at a plain character.
    """
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SEPARATORS, "," * len(SEPARATORS)), ","), "")


def split_tags(text: Column) -> Column:
    """Comma-joined normalised tags; null -> ''."""
    return F.array_join(tag_array(text), ",")


def stored_tags(tags: Column) -> Column:
    """Parts of a stored comma-joined tag string, trimmed, blanks dropped."""
    parts = F.split(F.coalesce(tags, F.lit("")), ",")
    return F.filter(F.transform(parts, lambda x: ustrip(x)), lambda x: x != "")


def skill_count(tags: Column) -> Column:
    """Number of non-blank comma parts (null -> 0)."""
    return F.size(stored_tags(tags))


def letter_runs(blob: Column) -> Column:
    return F.regexp_extract_all(blob, F.lit("[a-z]+"), F.lit(0))


def skill_hits(blob: Column, dictionary: list[tuple[str, list[str]]] | None = None,
               words: Column | None = None) -> Column:
    """Array of canonical names whose aliases hit the lower-cased ``blob``, dictionary order.

    C6: an alias made only of ASCII letters must have a non-letter (or the text
    edge) on both sides -- i.e. it must equal one maximal ``[a-z]+`` run of the
    text. So the text is tokenised once into its letter runs and those aliases are
    tested with ``arrays_overlap``; every other alias is a plain substring test.
    No regex per alias, no lambda.
    """
    dictionary = dictionary or dims.SKILL_DICT
    words = letter_runs(blob) if words is None else words
    hits = []
    for canon, aliases in dictionary:
        word_aliases = [a for a in aliases if a.isascii() and a.isalpha()]
        cond = None
        if word_aliases:
            cond = F.arrays_overlap(words, F.array(*[F.lit(a) for a in word_aliases]))
        for a in aliases:
            if a in word_aliases:
                continue
            h = F.instr(blob, a) > 0
            cond = h if cond is None else (cond | h)
        hits.append(F.when(cond, F.lit(canon)))
    return F.array_compact(F.array(*hits))


def extract_skills(*texts: Column, dictionary=None) -> Column:
    """Comma-joined canonical skills found in the given texts (whole texts)."""
    parts = [F.when(t != "", t) for t in texts]
    blob = F.lower(F.concat_ws(" ", *parts))
    return F.array_join(skill_hits(blob, dictionary), ",")


def alias_map_column(aliases: dict | None = None) -> Column:
    aliases = aliases or dims.TAG_ALIASES
    items = []
    for k, v in aliases.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def normalize_tag(tag: Column, aliases: dict | None = None) -> Column:
    """Trim, lower-case lookup in the alias map, else the trimmed tag."""
    t = ustrip(tag)
    return F.coalesce(F.try_element_at(alias_map_column(aliases), F.lower(t)), t)


def skill_set(tags: Column, aliases: dict | None = None) -> Column:
    """G1: distinct normalised skills of one posting."""
    amap = alias_map_column(aliases)
    return F.array_distinct(F.transform(
        stored_tags(tags),
        lambda x: F.coalesce(F.try_element_at(amap, F.lower(x)), x)))


def with_skills(df: DataFrame, text_cols: list[str], out: str,
                dictionary: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """``extract_skills`` as staged projections: the lower-cased text is a real
    column computed once per row before the dictionary tests run on it."""
    parts = [F.when(F.col(c) != "", F.col(c)) for c in text_cols]
    st = df.withColumn("__blob", F.lower(F.concat_ws(" ", *parts)))
    st = st.withColumn("__words", letter_runs(F.col("__blob")))
    st = st.withColumn("__hits", skill_hits(F.col("__blob"), dictionary, F.col("__words")))
    return (st.withColumn(out, F.array_join(F.col("__hits"), ","))
            .drop("__blob", "__words", "__hits"))
