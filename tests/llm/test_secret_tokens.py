"""Tokens that no pattern names: where they stand, and how many are found by encoding and length."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placebeat.llm import secret_scans
from tests.llm import brute

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
AROUND = ("key={}", 'AWS_KEY={} x', '{{"key":"{}"}}', "https://h.net/p?sig={}&x=1", "client_key='{}'", "a_very_long_name_of_a_key={}", "x=={}==", "é🙂={}", "see {} there")


def free_tokens(text):
    """(start, end) of maximal runs of 20 or more token characters with up to two equals signs."""
    inside, found, k = set(BASE64 + "-_"), [], 0
    while k < len(text):
        end = k
        while end < len(text) and text[end] in inside:
            end += 1
        if end - k >= 20:
            stop = end
            while stop < len(text) and stop < end + 2 and text[stop] == "=":
                stop += 1
            found.append((k, stop))
        k = end + 1
    return found


def test_tokens_behind_an_equals_sign(spark):
    rng = random.Random(12)
    rows = []
    for around in AROUND * 12:
        token = "".join(rng.choices(BASE64, k=rng.choice((40, 48))))
        rows.append((len(rows), around.format(token), token))
    frame = spark.createDataFrame(rows, "doc_id long, text string, token string")
    pattern = F.lit(secret_scans.PATTERNS["random"])
    tokens = {r["doc_id"]: r["tokens"] for r in frame.select("doc_id", F.regexp_extract_all("text", pattern, F.lit(0)).alias("tokens")).collect()}
    found = {r["doc_id"]: r["spans"] for r in secret_scans.secret_scans(frame).collect()}
    hit = {around: [] for around in AROUND}
    for k, text, token in rows:
        assert tokens[k] == [text[a:b] for a, b in free_tokens(text)]
        start = text.index(token)
        spans = [tuple(map(int, x.split(":")[1:])) for x in found[k].split(",") if x]
        assert brute.base_secrets(text) == "" and all(any(x <= a and b <= y for x, y in free_tokens(text)) for a, b in spans)
        hit[AROUND[k % len(AROUND)]].append(any(a <= start and start + len(token) <= b for a, b in spans))
    assert all(np.mean(x) >= 0.75 for x in hit.values()), hit


WORDS = "river stone bridge market garden window paper travel music letter winter summer handler request client version buffer config session account invoice section chapter".split()
HEX_WORDS = "dead beef face cafe feed deed decade facade added fade bead bad ace cab".split()
LENGTHS = (20, 24, 32)
#: Least share of random tokens found, of 120 each beside as many names: by encoding, at 20, 24 and 32 characters.
LEAST = {
    "hex": (0.6, None, None), "HEX": (0.6, 0.7, 0.8), "base32": (0.8, 0.85, 0.9), "lower36": (0.85, 0.85, 0.9), "upper36": (0.85, 0.85, 0.9),
    "base64url": (0.85, 0.85, 0.9), "base64": (0.85, 0.85, 0.9),
}


def name(encoding, length, rng):
    """A name of words and numbers in the encoding's alphabet."""
    words = HEX_WORDS if encoding.lower() == "hex" else WORDS
    digits = "234567" if encoding == "base32" else "0123456789"
    between = {"base64url": "_", "base64": "/"}.get(encoding, "")
    text = ""
    while len(text) < length:
        word = rng.choice(words)
        text += rng.choice([word, word.title() if between else word, "".join(rng.choices(digits, k=rng.randint(3, 8)))]) + between
    text = text[: length - 2] + rng.choice(digits) * 2
    if between:
        return "A" + text[1:-3] + "b" + text[-2:]
    text = rng.choice(words)[:3] + text[3:]
    return text.upper() if encoding in ("HEX", "base32", "upper36") else text


def shares_found(spark):
    """(encoding, length) -> share of random tokens found; and the share of names among all that is found."""
    rng, rows = random.Random(21), []
    for encoding, (_, letters) in secret_scans.ENCODINGS.items():
        for length, least in zip(LENGTHS, LEAST[encoding], strict=True):
            if least is not None:  # longer hexadecimal tokens have a pattern of their own
                rows += [(encoding, length, True, "".join(rng.choices(letters, k=length))) for _ in range(120)]
                rows += [(encoding, length, False, name(encoding, length, rng)) for _ in range(120)]
    frame = spark.createDataFrame([(k, f"see {r[-1]} there") for k, r in enumerate(rows)], "doc_id long, text string")
    hits, names = {}, []
    for r in secret_scans.secret_scans(frame).collect():
        encoding, length, secret, _ = rows[r["doc_id"]]
        if secret:
            hits.setdefault((encoding, length), []).append(r["n_random"] == 1)
        elif r["n_random"]:
            names.append(rows[r["doc_id"]])
    shares = {k: round(float(np.mean(v)), 2) for k, v in sorted(hits.items())}
    return shares, len(names) / max(1, len(names) + sum(map(sum, hits.values()))), names


def test_random_tokens_by_encoding_and_length(spark):
    shares, wrong, names = shares_found(spark)
    assert all(shares[encoding, length] >= least for encoding, row in LEAST.items() for length, least in zip(LENGTHS, row, strict=True) if least), shares
    assert wrong <= 0.03, names


@pytest.mark.parametrize("encoding", secret_scans.ENCODINGS)
def test_chances_of_words_add_up(encoding):
    letters = secret_scans.ENCODINGS[encoding][1]
    chances = 2 ** np.array(secret_scans.word_bits(letters)).reshape(len(letters), -1) / len(letters)
    assert chances.sum(axis=1) == pytest.approx(1)


ALPHANUMERIC = BASE64[:-2]
FORMS = {
    "bare": "see {} there", "quoted": "'{}'", "path": "https://hooks.host.com/services/T0_AB/{}", "path between": "https://api-eu.host.com/v1/users/{}/list-all", "query": "https://h.net/p?x=1&sig={}&y=2",
    "dotted": "part.{}.other", "prefixed": "sk_live_{}", "hyphens": "release-candidate-{}", "folder": "/home/user_name/some-folder/{}/file.txt",
}


def test_alphanumeric_tokens_by_form_and_length(spark):
    """Wherever a random token of 24 or more characters stands, it is found in nine of ten cases, and its span holds it."""
    rng, rows = random.Random(31), []
    for form, around in FORMS.items():
        for length in (24, 32, 40):
            rows += [(form, length, "".join(rng.choices(ALPHANUMERIC, k=length))) for _ in range(60)]
    texts = [FORMS[form].format(token) for form, _, token in rows]
    names = [f"https://{rng.choice(WORDS)}.host.com/{'/'.join(rng.choice(WORDS) + '-' + rng.choice(WORDS) + str(rng.randrange(99)) for _ in range(4))}/{rng.choice(WORDS)}_{rng.choice(WORDS)}" for _ in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts + names)), "doc_id long, text string")
    hits, spare = {}, 0
    for r in secret_scans.secret_scans(frame).collect():
        spans = [tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if x.startswith("random")]
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))  # none within another
        if r["doc_id"] < len(rows):
            form, length, token = rows[r["doc_id"]]
            start = texts[r["doc_id"]].index(token)
            hits.setdefault((form, length), []).append(any(a <= start and start + length <= b for a, b in spans))
        else:
            spare += bool(spans)
    shares = {k: round(float(np.mean(v)), 2) for k, v in hits.items()}
    assert all(x >= 0.85 for x in shares.values()) and np.mean(list(shares.values())) >= 0.93, shares
    assert spare <= 0.03 * len(names)


def segments(run):
    """(start, end) of the tokens within a run that are tested beside it."""
    out, at = set(), 0
    for part in run.split("/"):
        if len(part) >= 20:
            if "/" in run:
                out.add((at, at + len(part)))
            begin = at
            for piece in part.replace("_", "-").split("-"):
                if len(piece) >= 20 and piece != part:
                    out.add((begin, begin + len(piece)))
                begin += len(piece) + 1
        at += len(part) + 1
    return out


def test_segments_against_plain_python(spark):
    rng = random.Random(9)
    runs = ["".join(rng.choices("abcXYZ019+" + "/_-" * rng.randint(0, 1), k=rng.randint(20, 200))) + "=" * rng.randint(0, 2) for _ in range(300)]
    runs += ["a" * 20, "/" * 30, "a" * 25 + "/" + "b" * 25, "_" + "c" * 22 + "-" + "d" * 21 + "/" + "e" * 19, "f" * 10 + "/" + "g" * 30 + "_x"]
    frame = spark.createDataFrame([(k, 3, 100, 100 + len(x), x) for k, x in enumerate(runs)], "row long, order int, start long, end long, token string")
    found = {}
    for r in secret_scans.with_segments(frame, "row").collect():
        found.setdefault(r["row"], []).append(r)
        assert runs[r["row"]][r["start"] - 100 : r["end"] - 100] == r["token"] and r["run"] == 100
    for k, run in enumerate(runs):
        assert {(r["start"] - 100, r["end"] - 100) for r in found[k] if r["form"]} == segments(run.rstrip("=")), run
        assert [(r["token"], r["segment"]) for r in found[k] if not r["form"]] == [(run, None)]
