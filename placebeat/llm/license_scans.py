"""Licence scans by the Dice coefficient over word bigrams.

A text is normalised (A-Z lower-cased, all but letters, digits and newlines a blank). Its units are compared with the
templates as sets of word bigrams: its lines, its paragraphs (between blank lines), the whole, and, for each template,
its windows of as many words as the template has, across lines and paragraphs, that begin with a bigram of the template
(near the end of a text they are cut short). So a notice is found between other words and before code, too. Bounds keep
the comparisons few and lose none:

* A unit at Dice d or more shares d / (2 - d) of a template's bigrams, so of any larger share of them it holds one: the
  template's telling bigrams. Texts without any of these and units without a word of any are dropped by a regular
  expression each, and windows are only made around telling bigrams.
* A template is compared only with units whose number of bigrams is between d / (2 - d) and (2 - d) / d of its own.

Everything happens in the row: no join, no shuffle, whatever the number of equal texts. The templates are constants of
the plan, so their list must be one that a driver holds. A window costs as much as its template is long, and there are at
most as many per template as the text has words.

Null and empty texts, and those without a word, match nothing; a unit of one word has no bigram and matches nothing; of
equally alike licences the one of the longer template counts as the most alike, then the first by name; repeated rows
each get their row; an empty table gives no rows; columns other than those named are not read. DataFrame operations only.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placebeat.llm.license_templates import TEMPLATES
from placebeat.llm.support import narrow, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of a template, in order."""
    words = re.findall(r"[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def telling_bigrams(text: str, least: float) -> list[str]:
    """Bigrams of a template of which every unit that is ``least`` alike to it holds one.

    Those with the longest words are taken, one more than a similar unit may lack.
    """
    grams = template_bigrams(text)
    lacking = len(grams) - math.ceil(least / (2 - least) * len(grams) - 1e-9)
    return sorted(grams, key=lambda x: (-max(map(len, x.split())), x))[: lacking + 1]


def telling_words(templates: tuple[tuple[str, str], ...], least: float) -> list[str]:
    """The longer word of each telling bigram."""
    return sorted({max(x.split(), key=lambda w: (len(w), w)) for _, text in templates for x in telling_bigrams(text, least)})


def any_word(words: list[str]) -> str:
    """A regular expression for any of the words, by first letter."""
    groups = defaultdict(list)
    for word in words:
        groups[word[0]].append(word[1:])
    return r"\b(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in sorted(groups.items())) + r")\b"


def any_bigram(grams: list[str]) -> str:
    """A regular expression for any of the bigrams, also across lines, by first letter and word."""
    groups = defaultdict(lambda: defaultdict(list))
    for first, second in map(str.split, grams):
        groups[first[0]][first[1:]].append(second)
    by_word = lambda words: "|".join(f"{rest}[ \\n]+(?:{'|'.join(seconds)})" for rest, seconds in sorted(words.items()))
    return r"\b(?:" + "|".join(f"{letter}(?:{by_word(words)})" for letter, words in sorted(groups.items())) + r")\b"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[^a-z0-9\n]+", " ")


def pairs(unit: Column) -> Column:
    """Bigrams at all places of a unit."""
    words = F.filter(F.split(unit, r"[ \n]+"), lambda w: w != "")
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.concat_ws(" ", a, b))


def bigrams(unit: Column) -> Column:
    return F.array_distinct(pairs(unit))


def constant(templates: tuple[tuple[str, str], ...], least: float) -> Column:
    """The templates: bigrams, telling ones, places of bigrams, and bounds of the number of a similar unit's bigrams."""
    share, rows = least / (2 - least), []
    for name, text in templates:
        grams = template_bigrams(text)
        places = len(re.findall(r"[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))) - 1
        numbers = {"places": places, "low": math.ceil(len(grams) * share - 1e-9), "high": math.floor(len(grams) / share + 1e-9)}
        arrays = {"grams": grams, "telling": telling_bigrams(text, least)}
        rows.append(F.struct(F.lit(name).alias("license"), *(F.array(*map(F.lit, v)).alias(k) for k, v in arrays.items()), *(F.lit(v).alias(k) for k, v in numbers.items())))
    return F.array(*rows)


def fits(grams: Column, t: Column) -> Column:
    return (t["low"] <= F.size(grams)) & (F.size(grams) <= t["high"])


def likeness(grams: Column, t: Column) -> Column:
    return F.struct((-2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"]))).alias("minus"), (-F.size(t["grams"])).alias("shorter"), t["license"].alias("license"))


def window_matches(places: Column, known: Column, telling: list[str], least: float) -> Column:
    """For each template that a window of its length is like: the best likeness."""

    def starts(t: Column, anchors: Column) -> Column:
        # windows that hold an anchor and none before it, so each start comes once
        near = F.transform(anchors, lambda a, k: F.sequence(F.greatest(F.lit(1), a - t["places"] + 1, F.coalesce(F.get(anchors, k - 1), F.lit(0)) + 1), a))
        return F.filter(F.flatten(near), lambda s: F.array_contains(t["grams"], F.get(places, s - 1)))

    def best(t: Column, anchors: Column) -> Column:
        windows = F.transform(starts(t, anchors), lambda s: F.array_distinct(F.slice(places, s, t["places"])))
        return F.array_min(F.filter(F.transform(F.filter(windows, lambda g: fits(g, t)), lambda g: likeness(g, t)), lambda x: x["minus"] <= -least))

    def by_template(marked: Column) -> Column:
        anchored = F.transform(known, lambda t: F.struct(t.alias("t"), F.transform(F.filter(marked, lambda x: F.array_contains(t["telling"], x["gram"])), lambda x: x["at"]).alias("anchors")))
        return F.transform(F.filter(anchored, lambda x: F.size(x["anchors"]) > 0), lambda x: best(x["t"], x["anchors"]))

    marked = F.filter(F.transform(places, lambda g, k: F.struct((k + 1).alias("at"), g.alias("gram"))), lambda x: x["gram"].isin(telling))
    # an array of one, so that the marks are made once and not per template
    return F.filter(F.flatten(F.transform(F.array(marked), by_template)), lambda x: x.isNotNull())


def license_scans(
    frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8
) -> DataFrame:
    """id, license (the most alike, null if none), dice, licenses (all, by name, comma-joined) and n_licenses of every text."""
    texts = narrow(frame, id=id_column, text=text_column)
    known = constant(templates, least)
    sizes = [len(template_bigrams(text)) for _, text in templates]
    share = least / (2 - least)
    words = any_word(telling_words(templates, least))
    telling = sorted({x for _, text in templates for x in telling_bigrams(text, least)})
    whole = F.col("plain")
    units = F.concat(F.split(whole, "\n"), F.split(whole, r"\n *\n"), F.array(whole))
    some = texts.select("id", normalised(F.col("text")).alias("plain"))
    some = some.select("id", F.when(whole.rlike(words) & whole.rlike(any_bigram(telling)), whole).alias("plain"))
    none = F.array().cast("array<string>")
    some = some.select("id", F.coalesce(F.array_distinct(F.filter(units, lambda u: u.rlike(words))), none).alias("units"), F.coalesce(pairs(whole), none).alias("places"))
    sets = F.filter(F.transform("units", bigrams), lambda g: (F.size(g) >= min(sizes) * share - 1e-9) & (F.size(g) <= max(sizes) / share + 1e-9))
    some = some.select("id", "places", sets.alias("sets"))

    def matches(grams: Column) -> Column:
        return F.filter(F.transform(F.filter(known, lambda t: fits(grams, t)), lambda t: likeness(grams, t)), lambda x: x["minus"] <= -least)

    within = window_matches(F.col("places"), known, telling, least)
    found = some.select("id", F.array_sort(F.concat(F.flatten(F.transform("sets", matches)), within)).alias("found"))
    names = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["license"])))
    best = F.try_element_at("found", F.lit(1))
    return found.select(F.col("id").alias(id_column), best["license"].alias("license"), (-best["minus"]).alias("dice"), F.array_join(names, ",").alias("licenses"), F.size(names).cast("long").alias("n_licenses"))


def op7_license_scans(spark, sf_dir: str) -> DataFrame:
    return license_scans(table(spark, sf_dir, "documents"))


def license_sql() -> str:
    """DuckDB SQL for the query's rows, without the bounds."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(name)}, {quote(text)})" for name, text in TEMPLATES)
    plain = lambda x: f"regexp_replace(translate(coalesce({x}, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g')"
    grams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    words = lambda x: f"regexp_extract_all({x}, '[a-z0-9]+')"
    places = lambda w: f"list_transform(range(1, len({w})), lambda i: {{'i': i, 'gram': {w}[i] || ' ' || {w}[i + 1]}})"
    return f"""
WITH t AS (SELECT n, license, len(w) - 1 AS places, {grams('w')} AS g FROM (SELECT row_number() OVER () AS n, license, {words(plain('text'))} AS w FROM (VALUES {values}) v(license, text))),
d AS (SELECT doc_id, {plain('text')} AS p FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(p, chr(10)), regexp_split_to_array(p, '\\n *\\n'), [p])) AS u FROM d),
s AS (SELECT doc_id, {grams('w')} AS g FROM (SELECT doc_id, {words('u')} AS w FROM u)),
w AS (SELECT doc_id, {words('p')} AS w FROM d),
h AS (SELECT x.doc_id, t.n, x.x.i AS i, t.places, len(t.g) AS size FROM (SELECT doc_id, unnest({places('w')}) AS x FROM w) x
  JOIN (SELECT n, places, g, unnest(g) AS gram FROM t) t ON x.x.gram = t.gram),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, n ORDER BY i RANGE BETWEEN CURRENT ROW AND places - 1 FOLLOWING) AS hits FROM h),
k AS (SELECT w.doc_id, c.n, list_distinct(list_transform(range(c.i, least(c.i + c.places, len(w.w))), lambda i: w.w[i] || ' ' || w.w[i + 1])) AS g
  FROM c JOIN w USING (doc_id) WHERE 3 * c.hits >= 2 * c.size),
m AS (SELECT s.doc_id, t.license, len(t.g) AS size, 2.0::DOUBLE * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) AS dice FROM s, t
  WHERE len(s.g) > 0 AND 2 * least(len(s.g), len(t.g)) >= 0.8 * (len(s.g) + len(t.g))
  UNION ALL SELECT k.doc_id, t.license, len(t.g), 2.0::DOUBLE * len(list_intersect(k.g, t.g)) / (len(k.g) + len(t.g)) FROM k JOIN t USING (n)),
b AS (SELECT doc_id, arg_min(license, (-dice, -size, license)) AS license, max(dice) AS dice,
  string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT license) AS n FROM m WHERE dice >= 0.8 GROUP BY doc_id)
SELECT d.doc_id, b.license, b.dice, coalesce(b.licenses, '') AS licenses, coalesce(b.n, 0) AS n_licenses FROM d LEFT JOIN b USING (doc_id)
"""
