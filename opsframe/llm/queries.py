"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.llm import (
    fim, html, lines, packing, pieces, pii, search, simhash, sketches, spelling, token_files, toxicity, urls,
)
from opsframe.llm.common import table
from opsframe.session import scratch_dir

WORD_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"
TOXIC_SCORE = 0.7
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, docs.where("doc_id % 50 = 0"), k=10).withColumn("score", F.round("score", 6))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_recurring(table(spark, sf_dir, "documents"), report="dropped")
    return out.select("doc_id", "text", "n_chars", F.size("dropped").cast("long").alias("n_dropped"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES, siblings=True)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECE_MODEL)
    back = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/tokens"
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_TOKENIZER), end_id=2)
    return token_files.token_digest(token_files.read_tokens(spark, path))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.coalesce(toxicity.fold(F.col("doc_id")) == 1, F.lit(False))
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    return model.score(docs).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"),
        "n_words", *toxicity.FEATURES)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digest(pii.find(table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(table(spark, sf_dir, "documents"), seed=1, percent=90, spm_percent=20))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), typo_every=199), ratio=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_search": op1_search,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_url_filters": op4_url_filters,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_fingerprints": op6_fingerprints,
    "op7_token_files": op7_token_files,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_personal_data": op10_personal_data,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_html_text": op12_html_text,
    "op13_spelling": op13_spelling,
}
_SEARCH = r"""
with t as (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as w from documents),
c as (select doc_id, w, count(*) as tf from t group by all),
l as (select doc_id, count(*) as len from t group by doc_id),
s as (select (select count(*) from documents) as n, (select count(*) from t) * 1.0 / (select count(*) from documents) as mean),
f as (select w, count(*) as df from c group by w),
q as (select doc_id as query_id, w, tf * ln(1 + (n - df + 0.5) / (df + 0.5)) as weight from c join f using (w), s where doc_id % 50 = 0),
h as (select query_id, c.doc_id, sum(weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) as score
      from q join c using (w) join l on l.doc_id = c.doc_id, s group by all),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from h)
select query_id, rank, doc_id, round(score, 6) as score from r where rank <= 10
"""

_LINES = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, i, ls[i] as line from (select doc_id, ls, unnest(generate_series(1, len(ls))) as i from d)),
t as (select doc_id, i, string_split(trim(regexp_replace(regexp_replace(line, '\S*[0-9]\S*', '*', 'g'), '\s+', ' ', 'g'), ' '), ' ') as tk from l),
w as (select doc_id, i, tk, len(tk) as n, cast(ceil((len(tk) - 2) / 4.0) as int) as w from t where len(tk) >= 3),
k as (select doc_id, i, unnest(case when n >= 10 then [
        'x ' || array_to_string(tk, ' '),
        '0 ' || n || ' ' || array_to_string(tk[1:2] || tk[3 + w:], ' '),
        '1 ' || n || ' ' || array_to_string(tk[1:2 + w] || tk[3 + 2 * w:], ' '),
        '2 ' || n || ' ' || array_to_string(tk[1:2 + 2 * w] || tk[3 + 3 * w:], ' '),
        '3 ' || n || ' ' || array_to_string(tk[1:2 + 3 * w], ' ')] else ['x ' || array_to_string(tk, ' ')] end) as key from w),
g as (select distinct k.doc_id, i from k join (select key, min(doc_id) as first from k group by key) f using (key) where first < k.doc_id),
o as (select l.doc_id, count(g.i) as n_dropped, coalesce(string_agg(line, chr(10) order by l.i) filter (g.i is null), '') as text
      from l left join g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id)
select doc_id, text, length(text) as n_chars, n_dropped from o
"""

SQL: dict[str, str] = {"op1_search": _SEARCH, "op2_line_dedup": _LINES}
