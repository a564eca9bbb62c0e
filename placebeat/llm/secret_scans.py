"""Secret scans: three patterns, and a battery of randomness tests for tokens that no pattern names.

Matches are found with one pass of regular expressions over whole texts; a match's place is the sum of the lengths of
the gaps and matches before it. Tokens of 20 or more characters that hold digits, or both cases, are tested in the
encoding that their characters suggest (hexadecimal, base 32, lower or upper alphanumeric, base 64). A run of token
characters is tested as a whole and by its segments between slashes, underscores and hyphens; it gives one span, or one
for each of its segments:

* chi-squared uniformity over the encoding's alphabet,
* runs above and below the middle of the alphabet,
* serial correlation of neighbouring symbols.

A token that any test rejects as random (at ``alpha``, shared by the three) is none. For the others the likelihood of
the token as words (pairs of letters, changes between letters, cases, digits and marks) is held against that as random
symbols; the p-values go through Benjamini and Hochberg's procedure, separately for each encoding and length class. The
procedure works on a histogram of p-values (a bounded number of rows), over all tokens of the table.

Null counts as an empty text without spans; repeated rows each get their row; texts without matches have empty spans; an
empty table gives no rows; columns other than those named are not read. DataFrame operations only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placebeat.llm.support import fresh, stage, table
from placebeat.plans.stage import Stage

_KEYS = "|".join(("".join(f"[{x.upper()}{x}]" if x.isalpha() else x for x in key)) for key in ("password", "passwd", "secret", "token", "api_?key"))
#: Kinds in order, their patterns. The longer kinds ask for their least length in the pattern itself, which
#: finds the same maximal runs as dropping shorter ones afterwards.
PATTERNS = {
    "assign": rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}",
    "random": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}",
}
LEAST_TOKEN = 20  # characters of a token to be tested
BASE = ("assign", "access", "hex")
KINDS = tuple(PATTERNS)
#: Alphabets of the encodings, in order of preference.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = {
    "hex": ("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + _LOWER[:6]),
    "HEX": ("^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + _UPPER[:6]),
    "base32": ("^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", _UPPER + _DIGITS[2:8]),
    "lower36": ("^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", _LOWER + _DIGITS),
    "upper36": ("^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+$", _UPPER + _DIGITS),
    "base64url": ("^(?=.*[a-z0-9])(?=.*[A-Z0-9])(?=.*[A-Za-z])[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_"),
    "base64": ("^(?=.*[a-z0-9])(?=.*[A-Z0-9])(?=.*[A-Za-z])[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
}
#: Words as a chain of symbols: -2 log2 of the share of each letter a-z at the start of a word (first row) and after each
#: letter (a row each), in base 36; measured on the distinct words of 65 MB of Python sources.
WORD_LETTERS = (
    "797899bb8fea9998g878acaegg h989jeblamd687nan675ccgebk 6dac6fhi89l5fh7eja9c6klk8j 6icf6hj7ap88fh4fmad6ajknfo "
    "6ed93cgi5ikafe7fkc9a9higen 9g87aachemj9a6gac568ice8ek 7gee77gk4nm8gf5gn7c97ljlco 9gdf3fa77oi9c89ej78b8gilgh "
    "5ihg3iki6oideh5hoad8blkmem bb8aaaanhmf8847bjb77lbqdrc 7iee3iiibgcggg5dkg7g6cklgm 9fcc2edf5jh9eaddjd7cce9mem "
    "6gfa4chk5nj7hh7eng899ggn9m 5ahf4hjk7phdad75pgaf9jijeo 7h867b6h9kedgc7dmg75acijdm cba8ebdldkd984b9k5a88b9hlj "
    "5hfd5gje9rj6ig78l6b8ajkn8q agheghjihqg8hehgfbce1hgkkl 6gcb4ebk7pceaa6fl888befobq ajaf4efa7nddee99gh748hfldn "
    "7hbe4ei65ojceg8cn79aaiej9h 9aac7ccn9qn786f8u676klpipn 4hei2hhk6oqidhaiqhfhkjiiim 5gfd6hj65ohdh97hs79gjjbhmn "
    "8c6b6akf7lldbhe6kec5ighbcj bccc9dci9njaaa93k966hebhfe 7ihd1fhh7mjefg8fmiefgkihcc "
).split()
#: Share of letters that are taken as any letter, for names and words that English spelling doesn't cover.
ANY_LETTER = 0.15
#: Kinds of symbols, and the shares of kinds after each kind in names (measured on names of 20 or more characters in the
#: same sources). Encodings of two kinds change the kind with ``CHANGES``.
KINDS_AFTER = {"upper": (0.27, 0.68, 0.02, 0.03), "lower": (0.10, 0.82, 0.02, 0.06), "digit": (0.04, 0.12, 0.75, 0.09), "mark": (0.16, 0.69, 0.13, 0.02)}
CHANGES = 0.1
BINS_A_DECADE, DECADES = 20, 30


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def symbol_kind(symbol: str) -> str:
    return "upper" if symbol in _UPPER else "lower" if symbol in _LOWER else "digit" if symbol in _DIGITS else "mark"


def word_bits(alphabet: str) -> list[float]:
    """log2 of how many times likelier than at random words have the second symbol behind the first, for all pairs in order.

    Letters and kinds of symbols that the alphabet lacks are left out, so the chances behind each symbol add up to 1.
    """
    share = [[2 ** (-int(x, 36) / 2) for x in row] for row in WORD_LETTERS]
    groups = {kind: [x for x in alphabet if symbol_kind(x) == kind] for kind in KINDS_AFTER}
    groups = {kind: symbols for kind, symbols in groups.items() if symbols}
    out = []
    for first in alphabet:
        before = symbol_kind(first)
        after = dict(zip(KINDS_AFTER, KINDS_AFTER[before], strict=True)) if len(groups) > 2 else {kind: 1 - CHANGES if kind == before else CHANGES for kind in groups}
        chances = {}
        for kind, symbols in groups.items():
            weights = [1.0] * len(symbols)
            if kind in ("upper", "lower"):
                begins = before in ("digit", "mark") or (before, kind) == ("lower", "upper")
                row = share[0 if begins else 1 + _LOWER.index(first.lower())]
                weights = [row[_LOWER.index(x.lower())] for x in symbols]
                weights = [(1 - ANY_LETTER) * w / sum(weights) + ANY_LETTER / len(symbols) for w in weights]
            of_kind = after[kind] / sum(after[x] for x in groups)
            chances |= {x: of_kind * w / sum(weights) for x, w in zip(symbols, weights, strict=True)}
        out += [math.log2(len(alphabet) * chances[x]) for x in alphabet]
    return out


def battery(tokens: DataFrame) -> DataFrame:
    """Adds encoding, n, p_uniform, p_runs, p_serial and p_words to tokens with a column ``token``.

    Tokens in no encoding are left out. The first three are p-values of tests of randomness; p_words is the token's
    likelihood as words over that as random symbols, at most 1. Words reach a value p or less with a probability of at
    most p (Markov's inequality), so it is a p-value too, whatever the length.
    """
    body = F.regexp_replace("token", "=+$", "")
    encoding = F.coalesce(*(F.when(body.rlike(pattern), F.lit(name)) for name, (pattern, _) in ENCODINGS.items()))
    alphabet = F.create_map(*(x for name, (_, letters) in ENCODINGS.items() for x in (F.lit(name), F.lit(letters))))
    named = tokens.withColumn("body", body).withColumn("encoding", encoding).filter("encoding is not null")
    named = named.withColumn("alphabet", alphabet[F.col("encoding")])
    letters = F.filter(F.split("body", ""), lambda x: x != "")
    named = named.withColumn("codes", F.transform(letters, lambda x: F.instr(F.col("alphabet"), x) - 1))
    n, k = F.length("body").cast("double"), F.length("alphabet").cast("double")
    named = named.withColumns({"n": n, "k": k})
    seen = F.transform(F.array_distinct("codes"), lambda c: F.substring(F.col("alphabet"), c + 1, F.lit(1)))
    counts = F.transform(seen, lambda x: (F.length("body") - F.length(F.replace(F.col("body"), x, F.lit("")))).cast("double"))
    named = named.withColumn("squares", F.aggregate(counts, F.lit(0.0), lambda total, c: total + c * c))
    middle = F.col("k") / 2
    total = lambda array, term: F.aggregate(array, F.lit(0.0), lambda s, x: s + term(x))
    pairs = F.arrays_zip(F.slice("codes", 1, F.size("codes") - 1).alias("x"), F.slice("codes", 2, F.size("codes") - 1).alias("y"))
    named = named.withColumn("pairs", pairs).withColumn("mean", total("codes", lambda c: c.cast("double")) / F.col("n"))
    high = total("codes", lambda c: F.when(c >= middle, 1.0).otherwise(0.0))
    turns = total("pairs", lambda p: F.when((p["x"] >= middle) != (p["y"] >= middle), 1.0).otherwise(0.0))
    spread = total("codes", lambda c: (c - F.col("mean")) * (c - F.col("mean")))
    shared = total("pairs", lambda p: (p["x"] - F.col("mean")) * (p["y"] - F.col("mean")))
    named = named.withColumns({"high": high, "runs": turns + 1, "spread": spread, "shared": shared})
    n, k = F.col("n"), F.col("k")
    chi, free = k / n * F.col("squares") - n, k - 1
    z_uniform = (F.pow(F.greatest(chi, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    low = n - F.col("high")
    mean_runs = 2 * F.col("high") * low / n + 1
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    z_runs = F.when(var_runs > 0, (F.col("runs") - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(9.0))
    z_serial = F.when(F.col("spread") > 0, (F.col("shared") / F.col("spread") + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
    tables, offsets, listed = {name: word_bits(letters) for name, (_, letters) in ENCODINGS.items()}, [], []
    for name, bits in tables.items():
        offsets += [F.lit(name), F.lit(len(listed) + 1)]
        listed += bits
    offset = F.create_map(*offsets)[F.col("encoding")]
    listed = F.split(F.lit(",".join(f"{x:.4f}" for x in listed)), ",").cast("array<double>")
    bits = total("pairs", lambda p: F.element_at(listed, (F.col("offset") + p["x"] * F.col("k") + p["y"]).cast("int")))
    named = named.withColumn("offset", offset).withColumn("bits", bits)
    return named.withColumns({
        "p_uniform": upper_tail(z_uniform),
        "p_runs": 2 * upper_tail(F.abs(z_runs)),
        "p_serial": 2 * upper_tail(F.abs(z_serial)),
        "p_words": F.least(F.lit(1.0), F.pow(F.lit(2.0), F.col("bits"))),
    }).drop("offset", "bits", "body", "alphabet", "codes", "k", "squares", "pairs", "mean", "high", "runs", "spread", "shared")


def discovered(tested: DataFrame, alpha: float, false_share: float, store: Stage) -> DataFrame:
    """The tested tokens that are called random, under a false discovery share within each encoding and length class."""
    classed = tested.withColumn("length_class", F.floor(2 * F.log2("n"))).withColumn(
        "bin", F.greatest(F.lit(0), F.least(F.lit(BINS_A_DECADE * DECADES), F.floor(-F.log10(F.greatest("p_words", F.lit(1e-30))) * BINS_A_DECADE)))
    )
    classed = store.write("tested", classed)
    histogram = classed.groupBy("encoding", "length_class", "bin").agg(F.count(F.lit(1)).alias("tokens"))
    group = W.partitionBy("encoding", "length_class")
    better = F.sum("tokens").over(group.orderBy(F.desc("bin")))
    # the largest p-value of a bin against its rank: p <= share * rank / all
    highest = F.pow(F.lit(10.0), -F.col("bin") / BINS_A_DECADE)
    passing = histogram.withColumn("passes", highest <= false_share * better / F.sum("tokens").over(group))
    cuts = passing.filter("passes").groupBy("encoding", "length_class").agg(F.min("bin").alias("cut"))
    kept = classed.join(cuts, ["encoding", "length_class"]).filter(F.col("bin") >= F.col("cut"))
    least = F.lit(alpha / 3)
    return kept.filter((F.col("p_uniform") >= least) & (F.col("p_runs") >= least) & (F.col("p_serial") >= least))


def scanned(frame: DataFrame, text_column: str, row: str, store: Stage, carry: bool) -> DataFrame:
    """The frame's rows, each with a number, and of each kind its matches and the lengths of the gaps around them."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    columns = [F.col(f"`{x}`") for x in frame.columns if carry or x != text_column]
    found = frame.select(*columns, F.monotonically_increasing_id().alias(row), text.alias(f"{row}_text"))
    for kind, pattern in PATTERNS.items():
        found = found.withColumn(f"{row}_{kind}", F.regexp_extract_all(f"{row}_text", F.lit(pattern), F.lit(0)))
    for kind, pattern in PATTERNS.items():
        gaps = F.transform(F.split(f"{row}_text", pattern, -1), F.length)
        found = found.withColumn(f"{row}_{kind}_gaps", F.when(F.size(f"{row}_{kind}") > 0, gaps))
    return store.write("scanned", found.drop(f"{row}_text"))


def with_segments(runs: DataFrame, row: str) -> DataFrame:
    """Runs of token characters and, as tokens of their own, their long enough segments between slashes, underscores and hyphens.

    Adds run (the run's start), segment (number of the part between slashes, null for the run) and form: 0 for runs, 1 for parts
    between slashes, 2 for parts between any of the marks. A secret in a path or behind a prefix shares its run with other words.
    """
    body = F.regexp_replace("token", "=+$", "")
    marked = runs.filter(body.rlike("[/_-]")).select(row, "order", F.col("start").alias("run"), body.alias("body"))

    def cut(frame: DataFrame, text: str, begin: str, by: list[str], marks: str, number: str) -> DataFrame:
        """The parts of a text between marks of one character, with their places."""
        parts = frame.select("*", F.posexplode(F.split(text, marks)).alias(number, "part"))
        reach = F.sum(F.length("part") + 1).over(W.partitionBy(*by).orderBy(number))
        return parts.withColumn("start", F.col(begin) + reach - F.length("part") - 1)

    between = cut(marked, "body", "run", [row, "run"], "/", "segment").filter(F.length("part") >= LEAST_TOKEN)
    finer = between.filter(F.col("part").rlike("[_-]")).withColumnsRenamed({"part": "whole", "start": "begin"})
    finer = cut(finer, "whole", "begin", [row, "run", "segment"], "[_-]", "piece").filter(F.length("part") >= LEAST_TOKEN)
    columns = [row, "order", "start", (F.col("start") + F.length("part")).cast("long").alias("end"), F.col("part").alias("token"), "run", "segment"]
    whole = runs.select(row, "order", "start", F.col("end").cast("long").alias("end"), "token", F.col("start").alias("run"), F.lit(None).cast("int").alias("segment"), F.lit(0).alias("form"))
    between = between.filter(F.instr("body", "/") > 0).select(*columns, F.lit(1).alias("form"))
    return whole.unionByName(between).unionByName(finer.select(*columns, F.lit(2).alias("form")))


def spans(found: DataFrame, row: str, alpha: float, false_share: float, store: Stage) -> DataFrame:
    """(row, kind, order, start, end) of all secrets of the scanned rows."""
    each = []
    for order, kind in enumerate(KINDS):
        zipped = F.arrays_zip(F.col(f"{row}_{kind}").alias("token"), F.col(f"{row}_{kind}_gaps").alias("gap"))
        hits = found.filter(F.size(f"{row}_{kind}") > 0).select(row, F.posexplode(zipped).alias("k", "hit"))
        each.append(hits.select(F.col(row), F.lit(order).alias("order"), "k", F.col("hit.token").alias("token"), F.col("hit.gap").alias("gap")).filter("token is not null"))
    hits = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    until = F.sum(F.length("token") + F.col("gap")).over(W.partitionBy(row, "order").orderBy("k"))
    hits = hits.withColumn("end", until).withColumn("start", F.col("end") - F.length("token"))
    value = F.regexp_extract("token", f"^{PATTERNS['assign']}", 2)
    hits = hits.filter((F.col("order") > 0) | (F.length(value) >= 6)).select(row, "order", "start", "end", "token")
    hits = store.write("hits", hits)
    base = hits.filter(F.col("order") < len(BASE)).drop("token")
    free = with_segments(hits.filter(F.col("order") == len(BASE)), row).alias("h")
    taken = base.select(F.col(row).alias("of"), F.col("start").alias("from"), F.col("end").alias("to"))
    free = free.join(taken, (F.col(f"h.{row}") == F.col("of")) & (F.col("start") < F.col("to")) & (F.col("from") < F.col("end")), "left_anti")
    more = discovered(battery(free), alpha, false_share, store)
    # one span a token: the run if it is random as a whole, else the largest of its segments that are
    of_run, of_segment = F.min("form").over(W.partitionBy(row, "run")), F.min("form").over(W.partitionBy(row, "run", "segment"))
    more = more.withColumns({"of_run": of_run, "of_segment": of_segment}).filter((F.col("form") == 0) | (F.col("of_run") > 0) & (F.col("form") == F.col("of_segment")))
    more = more.select(row, "order", "start", "end")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("order") + 1)
    return store.write("spans", base.unionByName(more).withColumn("kind", kind))


def joined(rows: Column) -> Column:
    ordered = F.array_sort(F.collect_list(F.when(rows, F.struct("start", "order", "kind", "end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def secret_scans(
    frame: DataFrame, id_column: str = "doc_id", text_column: str = "text", alpha: float = 0.03, false_share: float = 0.01
) -> DataFrame:
    """id, n_assign, n_access, n_hex, n_random, base_sha256 and spans (code points, end exclusive) of every text."""
    store = stage(frame.sparkSession)
    row = "row_number_"
    found = scanned(frame.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").alias("text")), "text", row, store, carry=False)
    secrets = spans(found, row, alpha, false_share, store)
    of_row = secrets.groupBy(F.col(row).alias("of")).agg(
        *(F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in KINDS),
        joined(F.col("order") < len(BASE)).alias("base"),
        joined(F.lit(True)).alias("spans"),
    )
    whole = found.select(row, "id").join(of_row, F.col(row) == F.col("of"), "left")
    counts = [F.coalesce(f"n_{kind}", F.lit(0)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return whole.select(F.col("id").alias(id_column), *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def redact_secrets(frame: DataFrame, text_column: str = "text", mark: str = "[SECRET]", alpha: float = 0.03, false_share: float = 0.01) -> DataFrame:
    """The frame with every secret replaced by the mark; overlapping ones become one mark."""
    store = stage(frame.sparkSession)
    row, columns = fresh(frame, "row_number_"), frame.columns
    found = scanned(frame, text_column, row, store, carry=True)
    secrets = spans(found, row, alpha, false_share, store)
    ordered = W.partitionBy(row).orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    merged = secrets.withColumn("new", F.when(F.col("start") < reach, 0).otherwise(1)).withColumn("group", F.sum("new").over(ordered))
    merged = merged.groupBy(row, "group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = merged.groupBy(F.col(row).alias("of_")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts_"))
    text = F.col(f"`{text_column}`")
    begin = lambda k: F.when(k > 0, F.element_at("cuts_", F.greatest(k, F.lit(1)))["end"]).otherwise(F.lit(0))
    parts = F.transform("cuts_", lambda cut, k: F.concat(F.substring(text, begin(k).cast("int") + 1, (cut["start"] - begin(k)).cast("int")), F.lit(mark)))
    tail = F.substring(text, F.element_at("cuts_", -1)["end"].cast("int") + 1, F.length(text))
    new = F.when(F.col("cuts_").isNull(), text).otherwise(F.concat(F.array_join(parts, ""), tail))
    return found.join(cuts, F.col(row) == F.col("of_"), "left").select(*(new.alias(x) if x == text_column else F.col(f"`{x}`") for x in columns))


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    return secret_scans(table(spark, sf_dir, "documents"))
