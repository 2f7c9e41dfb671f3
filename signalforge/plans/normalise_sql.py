"""The normaliser restated in SQL for the raw records that the lens makes of documents: what the queries must equal."""

from __future__ import annotations

import re

from .. import lexicon
from ..functions import text as T
from ..operators import graph
from .lenses import EFFECTS, RAW_SQL, SYMPTOMS
from .normalise import FORCED, REVIEWS


def listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def in_list(values) -> str:
    return "(" + listed(values)[1:-1] + ")"


def map_of(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def seeds(text: str, terms: list[str]) -> str:
    tests = ", ".join(rf"CASE WHEN regexp_matches({text}, '\b{re.escape(s)}\b') THEN '{s}' END" for s in terms)
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


def kept(terms: str, of: list[str]) -> str:
    return f"list_filter({listed(of)}, lambda x: list_contains({terms}, x))"


def alias(terms: str) -> str:
    return f"list_transform({terms}, lambda x: coalesce({map_of(lexicon.ALIASES)}[x], x))"


def preferred(terms: str) -> str:
    return alias(f"list_transform({terms}, lambda x: coalesce({map_of(lexicon.PREFERRED_TERMS)}[lower(trim(x))], lower(trim(x))))")


def union(a: str, b: str) -> str:
    return f"list_distinct({a} || {b})"


def without(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


def longest(terms: str) -> str:
    return f"list_sort(list_filter(list_distinct({terms}), lambda x: len(list_filter({terms}, lambda y: y <> x AND contains(y, x))) = 0))"


def windows(pattern: str) -> str:
    """The 200 characters after each match: what stands between matches and the matches, from there on."""
    p = pattern.replace("'", "''")
    after = f"list_transform(range(1, len(m) + 1), lambda i: substr(array_to_string(flatten(list_transform(range(i, len(g)), lambda j: [g[j + 1], coalesce(m[j + 1], '')])), ''), 1, {T.CONTEXT_LENGTH}))"
    return f"(SELECT {after} FROM (SELECT regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g))"


def clean(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({text}, '<[^>]+>', ' ', 'g'), '[\s\x{{00A0}}]+', ' ', 'g'))"


DOSES = r"list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\b\d+(?:\.\d+)?\s*(?:mg|mcg|µg|g|ml|tablet|pill|capsule)s?\b'), lambda x: regexp_extract(x, '^[0-9.]+') || ' ' || regexp_replace(lower(regexp_extract(x, '[^0-9.\s]+$')), 's$', ''))))"
RESCUE = [s for s in lexicon.SIDE_EFFECTS if s not in lexicon.TRIAL_STOP_WORDS and lexicon.ALIASES.get(s, s) not in lexicon.TRIAL_OVERRIDES]
REVIEW_DAY = "CASE review_date WHEN '2020-01-05' THEN '2020-01-05' WHEN '2021/7/9' THEN '2021-07-09' WHEN 'March 5, 2022' THEN '2022-03-05' WHEN '5 Mar 2023' THEN '2023-03-05' WHEN '2024-02-30' THEN '2024-02-01' WHEN 'seen 2021-11-02 again' THEN '2021-11-02' WHEN '2025' THEN '2025-01-01' END"


def normalised(split_terms: bool = False) -> str:
    """Common table expressions, the last of which, `records`, has the normalised records."""
    stop = f"CASE WHEN source = 'clinicaltrials' THEN {listed([*lexicon.STOP_WORDS, *lexicon.TRIAL_STOP_WORDS])} ELSE {listed(lexicon.STOP_WORDS)} END"
    filtered = lambda terms: f"list_distinct({preferred(f'list_filter({terms}, lambda x: NOT list_contains(stop, x) AND length(x) > 2)')})"
    given = "[trim(x) for x in string_split(said, ', ')]" if split_terms else "[said]"
    authority = " ".join(f"WHEN '{'drugs.com' if k == 'drugscom' else k}' THEN 0.1::DOUBLE * {i}" for i, k in enumerate(graph.VARIANTS))
    return rf"""raw AS ({RAW_SQL}),
told AS (
  SELECT *, {listed(EFFECTS)}[doc_id % {len(EFFECTS)} + 1] AS effect, {listed(SYMPTOMS)}[doc_id % {len(SYMPTOMS)} + 1] AS symptom,
    {clean("regexp_replace(text, '[<>&]', ' ', 'g')")} AS abstract, {clean('text')} AS cleaned FROM raw),
said AS (
  SELECT *, CASE WHEN source = 'openfda' THEN effect || ', ' || symptom WHEN source = 'pubmed' THEN abstract WHEN source IN ('vigiaccess', 'webmd') THEN '' ELSE cleaned END AS said FROM told),
texts AS (
  SELECT doc_id, source, drug_name, url, source_id, review_date, said, effect, CASE source WHEN 'openfda' THEN drug_name || ' caused ' || said WHEN 'pubmed' THEN regexp_replace('. ' || said, '^[. ]+|[. ]+$', '', 'g')
    WHEN 'vigiaccess' THEN drug_name || ' adverse effects: ' || effect WHEN 'webmd' THEN drug_name || ' may cause the following side effects: ' || effect ELSE said END AS text,
    CASE source WHEN 'openfda' THEN {given} WHEN 'vigiaccess' THEN [effect] ELSE [] END AS given, {stop} AS stop FROM said),
found AS MATERIALIZED (
  SELECT *, {seeds('lower(text)', T.TERMS)} AS found,
    list_distinct(flatten(list_transform({windows(T.EFFECT_CONTEXT)}, lambda w: {seeds('lower(w)', lexicon.SIDE_EFFECTS)}))) AS near_effect,
    list_distinct(flatten(list_transform({windows(T.SYMPTOM_CONTEXT)}, lambda w: {seeds('lower(w)', lexicon.SYMPTOMS)}))) AS near_symptom FROM texts),
f1 AS (
  SELECT *, CASE WHEN source = 'clinicaltrials' THEN {kept('found', lexicon.TRIAL_SYMPTOMS)} ELSE [] END AS trial, list_distinct({preferred(kept('found', lexicon.SIDE_EFFECTS))}) AS e0,
    list_distinct({preferred(kept('found', lexicon.SYMPTOMS_NLP))}) AS s0, list_distinct({alias('near_effect')}) AS ce FROM found),
f2 AS (SELECT *, {union('e0', alias('list_transform(given, lambda x: lower(x))'))} AS e1, {without('s0', 'e0')} AS s1 FROM f1),
f3 AS (SELECT *, {union('e1', 'ce')} AS e2, {union('s1', without(alias('trial'), 'e1'))} AS s2, {without(f"list_distinct({alias(without('near_symptom', 'ce'))})", 'ce')} AS cs FROM f2),
f4 AS (SELECT *, {union('s2', 'cs')} AS s3, list_distinct({alias(without(kept('found', lexicon.SIDE_EFFECTS), 'stop'))}) AS le, list_distinct({alias(without(kept('found', lexicon.SYMPTOMS), 'stop'))}) AS ls FROM f3),
f5 AS (SELECT *, source IN {in_list([*FORCED, *REVIEWS])} OR len(e2) + len(s3) = 0 AS anywhere FROM f4),
f6 AS (SELECT *, CASE WHEN anywhere THEN {union('e2', 'le')} ELSE e2 END AS e3, CASE WHEN anywhere THEN {union('s3', without('ls', 'le'))} ELSE s3 END AS s4 FROM f5),
f7 AS (SELECT *, {filtered('e3')} AS e4, {filtered('s4')} AS s5 FROM f6),
f8 AS (SELECT *, {longest('e4')} AS se, {longest(without('s5', 'e4'))} AS sym FROM f7),
t1 AS (SELECT *, {without(union('se', alias(kept('found', RESCUE))), 'trial')} AS te FROM f8),
t2 AS (SELECT *, {longest(union('sym', without('trial', 'te')))} AS ts FROM t1),
records AS (
  SELECT doc_id, source, lower(trim(drug_name)) AS drug_name, url, review_date, CASE WHEN source = 'clinicaltrials' THEN {longest(preferred('te'))} ELSE se END AS side_effects,
    CASE WHEN source = 'clinicaltrials' THEN {longest(preferred('ts'))} ELSE sym END AS symptoms,
    CASE source WHEN 'clinicaltrials' THEN substr(said, 1, 3000) WHEN 'openfda' THEN said WHEN 'vigiaccess' THEN '' WHEN 'webmd' THEN substr(text, 1, 1000) ELSE substr(said, 1, 1000) END AS text_clean,
    CASE WHEN source = 'drugs.com' THEN ['unknown'] ELSE [] END AS conditions, CASE WHEN source = 'openfda' THEN [] ELSE {DOSES} END AS dosages,
    CASE WHEN source IN ('clinicaltrials', 'drugs.com', 'openfda', 'pubmed') THEN source_id END AS source_id, CAST(NULL AS VARCHAR) AS source_status, CAST(NULL AS VARCHAR) AS source_title, CAST(NULL AS VARCHAR) AS subreddit,
    CASE source {authority} END AS source_authority, 'hub' AS source_type
  FROM t2)"""


NORMALISED = f"WITH {normalised()} SELECT * EXCLUDE (review_date) FROM records"
#: Undated sources and trials without dates give no signals; the best signal is the latest.
MENTIONS = f"""WITH {normalised(split_terms=True)},
signals AS (SELECT source, lower(trim(drug_name)) AS drug, CASE WHEN source = 'reddit' THEN '' ELSE source_id END AS source_id, url, {REVIEW_DAY} AS day FROM raw WHERE source IN ('reddit', 'openfda', 'drugs.com')),
l1 AS (SELECT drug, source, source_id, max(day) AS day FROM signals WHERE source_id <> '' AND day IS NOT NULL GROUP BY ALL),
l2 AS (SELECT url, max(day) AS day FROM signals WHERE url IS NOT NULL AND day IS NOT NULL GROUP BY ALL),
l3 AS (SELECT drug, source, max(day) AS day FROM signals WHERE day IS NOT NULL GROUP BY ALL),
dated AS (
  SELECT r.drug_name AS drug, coalesce(l1.day, l2.day, l3.day) AS day, side_effects FROM records r LEFT JOIN l1 ON l1.drug = r.drug_name AND l1.source = r.source AND l1.source_id = r.source_id
  LEFT JOIN l2 ON l2.url = r.url AND r.source NOT IN ('openfda', 'drugs.com', 'reddit') LEFT JOIN l3 ON l3.drug = r.drug_name AND l3.source = r.source),
said_of AS (SELECT drug, substr(day, 1, 7) AS period, unnest(list_distinct(side_effects)) AS side_effect FROM dated WHERE day IS NOT NULL)
SELECT drug, side_effect, period, count(*) AS mention_count FROM said_of GROUP BY ALL"""
