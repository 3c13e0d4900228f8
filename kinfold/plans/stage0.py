"""Stage 0 in the registry: raw names and addresses to normalized records, over whole texts, and the prototypes' cleaners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import text as T
from ..operators import sampling as P
from ..session import table
from . import fixtures as fx
from .queries import register


def _map(known: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in known.items()) + "}"


def _ordered(values: str) -> str:
    """Distinct, the first of each kept in its place."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


_TAILS = "[" + ", ".join(f"'{t}'" for t in fx.RAW_TAILS) + "]"
_PLAIN = "lower(regexp_replace(strip_accents(replace(replace(replace({0}, '&amp;', ' and '), '&#38;', ' and '), '&', ' and ')), '[^\\x00-\\x7F]', '', 'g'))"
_WORDS = "list_transform(regexp_extract_all({0}, '\\b[a-z](?:\\.[a-z])+\\.?[a-z0-9]*|[a-z0-9]+'), lambda x: replace(x, '.', ''))"
_RAW = f"""WITH raw AS (SELECT doc_id::VARCHAR AS entity_id, {_PLAIN.format(f"(text || {_TAILS}[doc_id % {len(fx.RAW_TAILS)} + 1])")} AS n,
  {_PLAIN.format("('Apt 4b, 12 Main St. ' || text || ', Springfield ' || lpad((n_chars % 100000)::VARCHAR, 5, '0'))")} AS a FROM documents)"""

_NAMES = f"""{_RAW}, t AS (SELECT entity_id, {_WORDS.format('n')} AS t FROM raw),
kept AS (SELECT entity_id, list_filter(t, lambda x, i: NOT ((x = 'id' AND regexp_full_match(coalesce(t[i + 1], ''), '[0-9]+')) OR (regexp_full_match(x, '[0-9]+') AND i > 1 AND t[i - 1] = 'id'))) AS t FROM t),
whole AS (SELECT entity_id, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-z]') THEN translate(x, '{T.DIGITS}', '{T.LETTERS}') ELSE x END) AS t FROM kept),
legal AS (SELECT entity_id, [f FOR f IN list_transform(t, lambda x: {_map(N.LEGAL)}[x]) IF f IS NOT NULL] AS f, [x FOR x IN t IF {_map(N.LEGAL)}[x] IS NULL AND x NOT IN ({fx._NOISE})] AS core FROM whole),
named AS (SELECT entity_id, {_ordered('f')} AS forms, CASE WHEN len(core) = 0 THEN {_ordered('f')} ELSE core END AS words FROM legal)
SELECT entity_id, array_to_string(list_sort(list_distinct(words)), ' ') AS name_key, array_to_string(words, ' ') AS name_text, array_to_string(forms, ' ') AS name_suffix, len(words)::SMALLINT AS n_core FROM named"""


@register("stage0_names", _NAMES)
def stage0_names(spark, d):
    return N.normalize_records(fx.raw_records(spark, d), 1).select("entity_id", "name_key", "name_text", "name_suffix", "n_core")


_ADDRESSES = f"""{_RAW}, t AS (SELECT entity_id, trim(a) = '' AS addr_empty, {_WORDS.format('a')} AS w,
  CASE WHEN regexp_extract(a, '\\b\\d{{6}}\\b') <> '' THEN regexp_extract(a, '\\b\\d{{6}}\\b') ELSE regexp_extract(a, '\\b\\d{{5}}\\b') END AS postcode FROM raw),
cut AS (SELECT *, [x FOR x IN w IF x <> postcode AND NOT regexp_matches(x, '[0-9]')] AS words, [x FOR x IN w IF x <> postcode AND regexp_matches(x, '[0-9]')] AS nums FROM t)
SELECT entity_id, postcode, addr_empty, array_to_string({_ordered('nums')}, ' ') AS addr_nums,
  array_to_string([x FOR x IN list_transform(words, lambda x: coalesce({_map(N.ABBREVIATIONS)}[x], x)) IF x NOT IN ({fx._NOISE}, {', '.join(repr(w) for w in N.ADDRESS_NOISE)})], ' ') AS addr_text FROM cut"""


@register("stage0_addresses", _ADDRESSES)
def stage0_addresses(spark, d):
    return N.normalize_records(fx.raw_records(spark, d), 1).select("entity_id", "postcode", "addr_empty", F.array_join("addr_nums", " ").alias("addr_nums"), "addr_text")


@register("suffixed_text", f"""SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(string_split_regex(regexp_replace(regexp_replace(translate(lower(text), {fx._ACC}), '([a-z0-9_])&(amp;)?([a-z0-9_])', '\\1 and \\3', 'g'),
  '([a-z0-9_])&(amp;)?([a-z0-9_])', '\\1 and \\3', 'g'), '[^a-z0-9]+'), lambda x: coalesce({_map(T.PROTOTYPE_FORMS)}[x], x)), ' '), ' +', ' ', 'g')) AS plain FROM documents""")
def suffixed_text(spark, d):
    return table(spark, d, "documents").select("doc_id", P.suffixed_text(F.col("text")).alias("plain"))


@register("record_check", _NAMES.replace("SELECT entity_id, array_to_string(list_sort", "SELECT count(*) AS n, count(*) FILTER (name_key = '') AS empty, count(DISTINCT entity_id) AS ids FROM (SELECT entity_id, array_to_string(list_sort") + ")")
def record_check(spark, d):
    return N.record_check(N.normalize_records(fx.raw_records(spark, d), 1))

