"""Secrets against plain patterns and entropies counted anew for each window."""

import hashlib
import math
import random
import re
import string

from triagelake.llm import secrets
from triagelake.llm.queries import queries

SMALL = "/root/testdata/sf0.001"
NAMES = [*secrets.PATTERNED, *(k.name for k in secrets.CLASSES)]
#: The stated patterns: kind, expression, group whose length counts, least length.
PLAIN = (
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)


def plain_patterned(text):
    found = [(m.start(), m.end(), kind) for kind, e, g, least in PLAIN for m in re.finditer(e, text) if len(m.group(g)) >= least]
    return sorted(found, key=lambda s: (s[0], NAMES.index(s[2])))


def plain_windows(candidate):
    """Spans of windows by entropies counted anew."""
    spans = []
    for i in range(len(candidate) - secrets.WINDOW + 1):
        w = candidate[i : i + secrets.WINDOW]
        bits = -sum(n / len(w) * math.log2(n / len(w)) for n in (w.count(c) for c in set(w)))
        for k in secrets.CLASSES:
            kinds = [sum(c in s for c in w) for s in (secrets.DIGITS, secrets.LOWER, secrets.UPPER)]
            if set(w) <= set(k.members) and bits >= k.bits - 1e-9 and all(a >= b for a, b in zip(kinds, (k.digits, k.lower, k.upper), strict=True)):
                if spans and i <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + len(w), spans[-1][2])
                else:
                    spans.append((i, i + len(w), k.name))
                break
    return spans


def plain_secrets(text):
    found = plain_patterned(text)
    extra = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        allowed = any(re.search(a, m.group()) for a in secrets.ALLOW) or re.search(secrets.BEFORE, text[max(0, m.start() - 200) : m.start()], re.ASCII)
        if not allowed:
            extra += [(m.start() + a, m.start() + b, k) for a, b, k in plain_windows(m.group())]
    extra = [s for s in extra if not any(a < s[1] and s[0] < b for a, b, _ in found)]
    return sorted(found + extra, key=lambda s: (s[0], NAMES.index(s[2])))


def brute_row(doc_id, text):
    spans = plain_secrets(text or "")
    say = lambda some: ",".join(f"{k}:{a}:{b}" for a, b, k in some)
    base = [s for s in spans if s[2] in secrets.PATTERNED]
    return (doc_id, *(sum(s[2] == k for s in base) for k in secrets.PATTERNED), hashlib.sha256(say(base).encode()).hexdigest(), say(spans))


rng = random.Random(13)
draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
BASE64 = string.ascii_letters + string.digits + "+/"
ODD = [
    "", " ", 'token = "' + draw("0123456789abcdef", 40) + '"', "PASSWORD=abc12", "password=abc123", "Secret: token: abcdefgh", "api_key='x.y=z-12'", "APIkey :  = no", "toKen=abcdefg ſecret=abcdefg",
    "AKIA" + "A1" * 8, "AKIA" + "B2" * 7, "AKIAAKIA" + "C3" * 7, "xAKIA" + "D4" * 9 + "e", "f" * 23, "f" * 24, "é" * 5 + "0123456789abcdef" * 2, "key " + draw(BASE64, 44) + " end", draw(BASE64, 3000),
    draw("0123456789ABCDEF", 32), "https://example.org/a/" + draw(BASE64, 40), "123e4567-e89b-12d3-a456-426614174000", "internationalizationandlocalization", "abcdefghijklmnopqrstuvwxyz0123456789",
    draw(string.ascii_lowercase + string.digits, 30) + "/" + draw(string.ascii_lowercase, 30), "token=" + draw(BASE64, 30) + "!" + draw(BASE64, 30), "1234567890" * 5, "password" * 3000, "a" * 20_000, "😀 token:abcdef",
    draw("0123456789abcdef", 30) + draw(BASE64, 30), "EXAMPLE" + draw(BASE64, 30),
]


def test_windows_by_counts_anew():
    for _ in range(400):
        alphabet = rng.choice([BASE64, "0123456789abcdef", string.ascii_lowercase + string.digits, "0123456789ABCDEF", "ab01", BASE64 + "-_"])
        candidate = draw(alphabet, rng.randint(20, 70))
        if rng.random() < 0.4:
            candidate += draw(string.ascii_lowercase, rng.randint(0, 30)) + draw(BASE64, rng.randint(0, 40))
        assert secrets.entropic(candidate) == plain_windows(candidate)


def test_what_is_found_and_what_not():
    """Random tokens of every class are found; prose, addresses and identifiers are not."""
    kinds = {"lower_hex": "0123456789abcdef", "upper_hex": "0123456789ABCDEF", "lower_alnum": string.ascii_lowercase + string.digits, "upper_alnum": string.ascii_uppercase + string.digits, "base64": BASE64}
    for name, alphabet in kinds.items():
        assert sum(bool(secrets.entropic(draw(alphabet, 40))) for _ in range(100)) >= 97, name
    words = ["internationalization", "antidisestablishmentarianism", "Donaudampfschifffahrtsgesellschaft", "some_variable_name_of_mine", "2024-01-01-report-of-the-year", "src/main/java/org/thing/Part"]
    assert not any(secrets.entropic(w) for w in words)


def test_find_secrets_of_odd_rows(spark):
    rows = [(i, t, None, "kept") for i, t in enumerate(ODD)] + [(None, "token=abcdefg", 3, ""), (7, None, 4, None), (2, ODD[2], None, "again")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, secrets int, text_of_secrets string").repartition(3)
    found = secrets.find_secrets(frame)
    assert found.columns == ["doc_id", "text", "text_of_secrets", "secrets"]
    got = sorted(((r.doc_id, r.text, r.text_of_secrets, [(x.start, x.end, x.kind) for x in r.secrets]) for r in found.collect()), key=str)
    assert got == sorted(((i, t, k, plain_secrets(t or "")) for i, t, _, k in rows), key=str)
    assert sorted(map(tuple, secrets.secret_digest(found).collect()), key=str) == sorted((brute_row(i, t) for i, t, *_ in rows), key=str)
    assert secrets.find_secrets(frame.limit(0)).count() == 0
    for r in secrets.redact(found).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id) if r.doc_id != 7 else r.text
        hidden = [any(x.start <= i < x.end for x in r.secrets) for i in range(len(text or ""))]
        kept = "".join(c if not h else "\0" if not (i and hidden[i - 1] and not any(x.start == i and not any(y.start < i < y.end for y in r.secrets) for x in r.secrets)) else "" for i, (c, h) in enumerate(zip(text or "", hidden, strict=True)))
        assert (r.text or "") == kept.replace("\0", "[secret]")


def test_allow_list_is_a_parameter(spark):
    token = draw(BASE64, 40)
    frame = spark.createDataFrame([(1, f"see {token} here")], "doc_id long, text string")
    assert secrets.find_secrets(frame).first().secrets
    assert not secrets.find_secrets(frame, allow=(re.escape(token),)).first().secrets


def test_query_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"), allowMissingColumns=True)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries()["op13_secrets"](spark, str(tmp_path)).collect()))
    assert got == sorted(brute_row(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
