"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

DataFrame functions only.  A file with a licence cue gives *units*, each a sparse TF-IDF vector: its lines and
sentences, its blocks (up to a blank line, with wrapped lines joined), its leading comment and its whole
text, all without comment marks.  The cosine of a unit to the short notices, headers and bodies in
``licence_texts`` picks a licence.  Inverse document frequencies count the units of *all* files; a word of no
template gets the largest value, so only the templates' words, a bounded table, are broadcast.  An
``SPDX-License-Identifier`` is taken as it stands, before any cosine.  ``Proprietary`` holds only where nothing
else does, as other licences also reserve rights.

A file without a notice of its own inherits from the licence file of its own directory or else of the nearest directory
above: ancestors of distinct directories are joined to the directories that have one.  Files
meet directories last, so a directory that holds a third of all files is one row until then.

Defined cases: null text is empty, a null path is the root; files without a notice or a licensed
ancestor get no licence; equal cosines go to the smaller licence name; two licence files in a directory: the
larger cosine, then the smaller name; rows that repeat an id each have their own notice, as have rows without an
id; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .licence_texts import PROPRIETARY, TEMPLATES

CUE = (
    r"licen[sc]e|copyright|spdx|rights reserved|public domain|creative commons|all copyright|no attribution|permission is |permission to use|redistribution and use|"
    r"free software|provided as-is|neither the name|gnu general public|terms of the"
)
LEAST = 0.6
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
SPDX = r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+(?: +(?:OR|AND|WITH) +[A-Za-z0-9.+-]+)*)"
#: Comment marks at the start of a line, and a line of the leading comment.
MARKS = r"(^|\n)[ \t]*(?:<!--|-->|/\*+|\*+/|\*+|//+|#+|--+|;+)"
COMMENT = r"^[ \t\r]*(?:<!--|-->|/\*|\*|//|#|--|;|$)"
SPACE = r"[ \t\r\n]+"


def _units(files: DataFrame) -> DataFrame:
    """``doc_id, row_key, u, unit``: the distinct units with a cue of each file, in lower case; ``u`` is a hash."""
    low = F.lower(F.coalesce("text", F.lit("")))
    plain = F.regexp_replace(low, MARKS, "$1")
    blocks = F.transform(F.split(plain, r"\n[ \t\r]*\n"), lambda b: F.regexp_replace(b, SPACE, " "))
    sentences = F.flatten(F.transform(blocks, lambda b: F.split(F.regexp_replace(b, r"([.!?]) ", "$1\n"), "\n")))
    lines = F.split(F.regexp_replace(plain, rf"([.!?]){SPACE}", "$1\n"), "\n")
    rows = F.split(low, "\n")
    other = F.array_position(F.transform(rows, lambda x: x.rlike(COMMENT)), False)
    top = F.array_join(F.slice(rows, F.lit(1), F.greatest(F.lit(0), F.when(other == 0, F.size(rows)).otherwise(other - 1)).cast("int")), "\n")
    top = F.regexp_replace(F.regexp_replace(top, MARKS, "$1"), SPACE, " ")
    every = F.concat(lines, sentences, blocks, F.array(top, F.regexp_replace(plain, SPACE, " ")))
    units = F.array_distinct(F.transform(F.filter(every, lambda x: x.rlike(CUE)), F.trim))
    found = files.where(low.rlike(CUE)).select("doc_id", _row_key().alias("row_key"), F.explode(units).alias("unit"))
    return found.select("doc_id", "row_key", F.md5("unit").alias("u"), "unit")


def _row_key() -> Column:
    """With ``doc_id`` it tells rows apart, but those that are equal in path and text."""
    return F.xxhash64(F.coalesce("path", F.lit("")), F.coalesce("text", F.lit("")))


def _tokens(rows: DataFrame, text: str, *keys: str) -> DataFrame:
    """``keys, token, tf``."""
    words = F.filter(F.split(F.regexp_replace(text, r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    return rows.select(*keys, F.explode(words).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))


def notices(files: DataFrame, *, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """``doc_id, row_key, licence, cosine``: the best notice of each of ``files(doc_id, path, text)`` that has one."""
    spark: SparkSession = files.sparkSession
    forms = spark.createDataFrame([(i, *t) for i, t in enumerate(templates or TEMPLATES)], "form int, licence string, text string")
    form_tokens = _tokens(forms.withColumn("text", F.lower("text")), "text", "form", "licence")
    units = written(_units(files))
    # Copies of a unit are one vector.
    distinct = units.groupBy("u").agg(F.count(F.lit(1)).alias("copies"), F.min("unit").alias("unit"))
    tokens = written(_tokens(distinct, "unit", "u", "copies"))
    known = form_tokens.select("token").distinct()
    total = units.agg(F.count(F.lit(1)).alias("total"))
    frequency = tokens.join(F.broadcast(known), "token").groupBy("token").agg(F.sum("copies").alias("df"))
    weights = known.join(frequency, "token", "left").crossJoin(F.broadcast(total))  # one row on the right
    weights = weights.select("token", (F.log((F.col("total") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf"))
    forms = form_tokens.join(weights, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norms = forms.groupBy("form").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    forms = forms.join(norms, "form").select("form", "licence", "token", (F.col("w") / F.col("norm")).alias("form_w"))

    weighed = tokens.join(F.broadcast(weights), "token", "left").crossJoin(F.broadcast(total))
    weighed = weighed.withColumn("w", F.col("tf") * F.coalesce("idf", F.log(F.col("total") + 1) + 1))
    length = weighed.groupBy("u").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dot = weighed.join(F.broadcast(forms), "token").groupBy("u", "form", "licence").agg(F.sum(F.col("w") * F.col("form_w")).alias("dot"))
    cosine = dot.join(length, "u").select("u", "licence", F.round(F.col("dot") / F.col("length"), 6).alias("cosine")).where(F.col("cosine") >= least)
    best = cosine.groupBy("u").agg(F.min(F.struct((F.col("licence") == PROPRIETARY).alias("p"), (-F.col("cosine")).alias("c"), "licence")).alias("b"))
    found = units.select("doc_id", "row_key", "u").join(best, "u").groupBy("doc_id", "row_key").agg(F.min("b").alias("b"))
    found = found.select("doc_id", "row_key", "b.licence", (-F.col("b.c")).alias("cosine"))
    named = F.regexp_extract(F.coalesce("text", F.lit("")), SPDX, 1)
    spdx = files.where(F.col("text").contains("SPDX")).select("doc_id", _row_key().alias("row_key"), named.alias("spdx")).where("spdx <> ''").distinct()
    both = found.select("doc_id", "row_key", "licence", "cosine", F.lit(1).alias("rank")).unionByName(spdx.select("doc_id", "row_key", F.col("spdx").alias("licence"), F.lit(1.0).alias("cosine"), F.lit(0).alias("rank")))
    return both.groupBy("doc_id", "row_key").agg(F.min(F.struct("rank", "licence", "cosine")).alias("x")).select("doc_id", "row_key", "x.licence", "x.cosine")


def parent(path):
    """The directory of a path; '' is the root."""
    return F.regexp_replace(F.when(F.instr(path, "/") == 0, "").otherwise(path), r"/[^/]*$", "")


def scan_licences(files: DataFrame, *, templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """``doc_id, path, licence, cosine, origin`` of every file of ``files(doc_id, path, text)``.

    ``origin`` is ``own``, ``inherited`` or null; ``licence_dir`` is the directory inherited from.
    """
    found = notices(files, templates=templates, least=least)
    paths = files.select("doc_id", F.coalesce("path", F.lit("")).alias("path"), _row_key().alias("row_key")).withColumn("dir", parent(F.col("path")))
    same = paths["doc_id"].eqNullSafe(found["doc_id"]) & (paths["row_key"] == found["row_key"])
    own = written(paths.join(found, same, "left").select(paths["doc_id"], "path", "dir", "licence", "cosine"))
    licensed = own.where(F.col("path").rlike(LICENCE_FILE) & F.col("licence").isNotNull())
    licensed = licensed.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("b"))
    licensed = licensed.select(F.col("dir").alias("above"), F.col("b.licence").alias("dir_licence"), (-F.col("b.c")).alias("dir_cosine"))

    dirs = own.where("licence IS NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = dirs.select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), up))).alias("above"))
    nearest = above.join(licensed, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "dir_licence", "dir_cosine")).alias("x"))
    rows = own.join(nearest, "dir", "left")
    inherits = F.col("licence").isNull() & F.col("x").isNotNull()
    return rows.select(
        "doc_id",
        "path",
        F.coalesce("licence", "x.dir_licence").alias("licence"),
        F.coalesce("cosine", "x.dir_cosine").alias("cosine"),
        F.when(F.col("licence").isNotNull(), "own").when(inherits, "inherited").alias("origin"),
        F.when(inherits, F.col("x.above")).alias("licence_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree: source, language and one of 97 folders; each fifth is a licence file."""
    name = F.when(F.col("doc_id") % 5 == 0, "LICENSE").otherwise(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), (F.col("doc_id") % 97).cast("string"), name)
    return docs.select("doc_id", path.alias("path"), "text")


def oracle_sql() -> str:
    """DuckDB SQL for :func:`scan_licences` over :func:`document_files` of ``documents``."""
    forms = ", ".join("({}, '{}', '{}')".format(i, *(x.replace("'", "''") for x in t)) for i, t in enumerate(TEMPLATES))
    return rf"""
WITH files AS (
  SELECT doc_id, concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', doc_id % 97) AS dir,
         CASE WHEN doc_id % 5 = 0 THEN 'LICENSE' ELSE concat('doc-', doc_id, '.txt') END AS name, coalesce(text, '') AS text
  FROM documents),
cued AS (SELECT doc_id, lower(text) AS low, regexp_replace(lower(text), '{MARKS}', '\1', 'g') AS plain FROM files WHERE regexp_matches(lower(text), '{CUE}')),
cut AS (
  SELECT doc_id, plain, string_split(low, chr(10)) AS rows, list_transform(regexp_split_to_array(plain, '\n[ \t\r]*\n'), lambda b: regexp_replace(b, '{SPACE}', ' ', 'g')) AS blocks FROM cued),
headed AS (SELECT *, coalesce(list_position(list_transform(rows, lambda x: regexp_matches(x, '{COMMENT}')), false), 0) AS other FROM cut),
every AS (
  SELECT doc_id, list_concat(list_concat(
    string_split(regexp_replace(plain, '([.!?]){SPACE}', '\1' || chr(10), 'g'), chr(10)),
    flatten(list_transform(blocks, lambda b: string_split(regexp_replace(b, '([.!?]) ', '\1' || chr(10), 'g'), chr(10))))), list_concat(blocks, [
    regexp_replace(regexp_replace(array_to_string(rows[1:CASE WHEN other = 0 THEN len(rows) ELSE other - 1 END], chr(10)), '{MARKS}', '\1', 'g'), '{SPACE}', ' ', 'g'),
    regexp_replace(plain, '{SPACE}', ' ', 'g')])) AS pieces FROM headed),
units AS (SELECT DISTINCT doc_id, trim(piece) AS unit FROM (SELECT doc_id, unnest(pieces) AS piece FROM every) WHERE regexp_matches(piece, '{CUE}')),
one AS (SELECT unit AS sentence, count(*) AS copies FROM units GROUP BY 1),
tokens AS (
  SELECT sentence, copies, token, count(*) AS tf FROM (
    SELECT sentence, copies, unnest(string_split(regexp_replace(sentence, '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM one)
  WHERE token <> '' GROUP BY 1, 2, 3),
forms0 AS (
  SELECT form, licence, token, count(*) AS tf FROM (
    SELECT form, licence, unnest(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ')) AS token FROM (VALUES {forms}) t(form, licence, text))
  WHERE token <> '' GROUP BY 1, 2, 3),
total AS (SELECT count(*)::DOUBLE AS total FROM units),
weights AS (
  SELECT token, ln((total + 1) / (coalesce(df, 0) + 1)) + 1 AS idf
  FROM (SELECT DISTINCT token FROM forms0) k
  LEFT JOIN (SELECT token, sum(copies)::DOUBLE AS df FROM tokens GROUP BY 1) d USING (token), total),
forms1 AS (SELECT form, licence, token, tf * idf AS w FROM forms0 JOIN weights USING (token)),
forms AS (SELECT form, licence, token, w / norm AS form_w FROM forms1 JOIN (SELECT form, sqrt(sum(w * w)) AS norm FROM forms1 GROUP BY 1) USING (form)),
weighed AS (SELECT sentence, token, tf * coalesce(idf, ln(total + 1) + 1) AS w FROM tokens LEFT JOIN weights USING (token), total),
cosines AS (
  SELECT sentence, licence, round(dot / length, 6) AS cosine
  FROM (SELECT sentence, form, licence, sum(w * form_w) AS dot FROM weighed JOIN forms USING (token) GROUP BY 1, 2, 3)
  JOIN (SELECT sentence, sqrt(sum(w * w)) AS length FROM weighed GROUP BY 1) USING (sentence)),
best AS (
  SELECT doc_id, licence, cosine FROM units JOIN cosines ON unit = sentence WHERE cosine >= {LEAST}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY licence = '{PROPRIETARY}', cosine DESC, licence) = 1),
named AS (SELECT doc_id, regexp_extract(text, '{SPDX}', 1) AS spdx FROM files),
own AS (
  SELECT files.doc_id, dir, name, coalesce(nullif(spdx, ''), licence) AS licence, CASE WHEN spdx <> '' THEN 1.0 ELSE cosine END AS cosine
  FROM files JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)),
licensed AS (
  SELECT dir AS above, licence AS dir_licence, cosine AS dir_cosine FROM own WHERE name = 'LICENSE' AND licence IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, licence) = 1),
nearest AS (
  SELECT dir, above, dir_licence, dir_cosine FROM (SELECT DISTINCT dir FROM own) d JOIN licensed l ON d.dir = l.above OR starts_with(d.dir, l.above || '/') OR l.above = ''
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY length(above) DESC) = 1)
SELECT doc_id, concat(own.dir, '/', name) AS path, coalesce(licence, dir_licence) AS licence, coalesce(cosine, dir_cosine) AS cosine,
       CASE WHEN licence IS NOT NULL THEN 'own' WHEN dir_licence IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN licence IS NULL THEN above END AS licence_dir
FROM own LEFT JOIN nearest USING (dir)"""
