"""Secret scans against a plain version: patterns by `re`, tests by `math.erfc`, discoveries by a sort of all candidates."""

import hashlib
import math
import random
import re
import string
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from locusloom.llm import secrets

ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16])


def upper(z):
    return math.erfc(z / math.sqrt(2)) / 2


def kind_of(token):
    for name, (_, must, alphabet) in secrets.ENCODINGS.items():
        if set(token) <= set(alphabet) and all(re.search(f"[{m}]", token) for m in must):
            return name
    return None


def plain_p_random(token, alphabet):
    n, a, code = len(token), len(alphabet), [alphabet.index(c) for c in token]
    chi = a / n * sum(c * c for c in Counter(code).values()) - n
    mean, var = a - 1, 2 * (a - 1) * (n - 1) / n
    c, df = var / (2 * mean), 2 * mean**2 / var
    uniform = upper(((chi / (c * df)) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df)))
    bits = [2 * x >= a for x in code]
    ones = sum(bits)
    if ones in (0, n):
        runs = 2.0 ** (1 - n)
    else:
        expected = 2 * ones * (n - ones) / n + 1
        turns = 1 + sum(x != y for x, y in zip(bits, bits[1:]))
        runs = 2 * upper(abs(turns - expected) / math.sqrt((expected - 1) * (expected - 2) / (n - 1)))
    sx, sxx, sxy = sum(code), sum(x * x for x in code), sum(x * y for x, y in zip(code, code[1:] + code[:1]))
    spread = n * sxx - sx * sx
    serial = 2 * upper(abs((n * sxy - sx * sx) / spread + 1 / (n - 1)) * (n - 1) / math.sqrt(n * (n - 3) / (n + 1))) if spread else 0
    bend = [math.tan((0.5 - min(max(p, 1e-15), 0.99)) * math.pi) for p in (uniform, runs, serial)]
    return 0.5 - math.atan(sum(bend) / 3) / math.pi


def plain_scan(rows):
    count = Counter(c for _, t in rows for c in t or "")
    found, strata = [], defaultdict(list)
    for at, (_, text) in enumerate(rows):
        base = plain_base(text or "")
        for m in re.finditer(r"[^\W_]+(?:[^\W_]|[+/_-])*|[+/_-](?:[^\W_]|[+/_-])*", text or ""):
            token = m[0]
            kind = kind_of(token) if len(token) >= 20 else None
            if kind is None:
                continue
            alphabet, n = secrets.ENCODINGS[kind][2], len(token)
            total = sum(count[c] for c in alphabet)
            q = [count[c] / total for c in alphabet]
            two, three = sum(x**2 for x in q), sum(x**3 for x in q)
            pairs = sum(c * (c - 1) for c in Counter(token).values()) / (n * (n - 1))
            var = (4 * (n - 2) * (three - two**2) + 2 * (two - two**2)) / (n * (n - 1))
            p = max(upper((two - pairs) / math.sqrt(max(var, 1e-12))), 1e-300)
            score, stratum = math.floor(-100 * math.log10(p)), (kind, int(math.log2(n)))
            strata[stratum].append(score)
            found.append((at, m.start(), m.end(), stratum, score, plain_p_random(token, alphabet), base))
    least = {}
    for stratum, scores in strata.items():
        fits = [s for s in scores if 10 ** (-s / 100) <= 0.01 * sum(x >= s for x in scores) / len(scores)]
        least[stratum] = min(fits, default=1 << 30)
    extra = defaultdict(list)
    for at, start, end, stratum, score, p, base in found:
        if p >= 0.001 and score >= least[stratum] and not any(b[0] <= start and end <= b[2] for b in base):
            extra[at].append((start, 3, end))
    return [(i, sorted(plain_base(t or "") + extra[at])) for at, (i, t) in enumerate(rows)]


def token(rng, chars, n):
    return "".join(rng.choice(chars) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    words = [token(rng, "eeeeaaattoinshrdlu", rng.randint(2, 9)) for _ in range(300)] + ["Straße", "élève", "naïve", "𝔘nicode"]
    rows = []
    for i in range(240):
        text = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            text.insert(rng.randint(0, len(text)), token(rng, string.ascii_letters + string.digits, rng.choice([24, 40, 64])))
        if i % 5 == 0:
            text.insert(0, token(rng, string.ascii_letters + string.digits + "+/", 44))
        if i % 7 == 0:
            text += [rng.choice(words) * 6, "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOP", "/usr/share/lib/python3/dist-packages"]
        if i % 4 == 0:
            text += [rng.choice(["Token", "api_key", "PASSWD", "apikey", "secret"]) + rng.choice(["=", ' : "', "'= '", "  ="]) + token(rng, string.hexdigits + "._", rng.randint(8, 30))]
        if i % 6 == 0:
            text += ["AKIA" + token(rng, string.ascii_uppercase + string.digits, rng.randint(10, 20)), token(rng, "0123456789abcdef", rng.randint(12, 40))]
        rows.append((i, " ".join(text)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, id long")


def got(spark, rows):
    out = secrets.scan(frame(spark, rows)).collect()
    return sorted(((r.doc_id, [(s["start"], s.kind_no, s.end) for s in r.spans]) for r in out), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_plain_version(spark, seed):
    rows = corpus(seed)
    expected = sorted(plain_scan(rows), key=str)
    assert got(spark, rows) == expected
    assert 40 < sum(s[1] == 3 for _, spans in expected for s in spans) < 140


def test_finds_random_tokens_and_leaves_ordinary_ones(spark):
    rng = random.Random(5)
    tokens = [(i, "see " + token(rng, string.ascii_letters + string.digits, 40) + " there") for i in range(50)]
    plain = [(100 + i, " ".join(token(rng, "eeeaattoinshr", 22) for _ in range(20))) for i in range(50)]
    ordered = [(200 + i, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for i in range(5)]
    found = dict(got(spark, tokens + plain + ordered))
    assert sum(bool(found[i]) for i, _ in tokens) >= 48
    assert not any(found[i] for i, _ in plain + ordered)


def test_odd_rows(spark):
    rows = [
        (1, None), (2, ""), (None, "token=abcdefghijkl"), (3, "token=abcdefghijkl"), (3, "token=abcdefghijkl"), (None, None),
        (4, "token = secret: abcdefghijklmnop"), (5, "𝔘𝔘 api_key='0123456789abcdef'"), (6, "AKIA" + "A" * 13 + " AKIA" + "B" * 14),
        (7, "password" * 3 + " " * 50), (8, "token=" * 5000), (9, " ".join(["0123456789abcdef"] * 3000)), (10, "a" * 200_000), (11, "Key toKen=abcdefghijkl"),
    ]
    assert got(spark, rows) == sorted(plain_scan(rows), key=str)
    assert secrets.scan(frame(spark, [])).count() == 0
    assert got(spark, [(1, None), (2, "")]) == [(1, []), (2, [])]


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 2000])
def test_running_starts(spark, n):
    sizes = [(7 * i) % 11 for i in range(n)]
    row = spark.createDataFrame([(sizes,)], "x array<long>").select(secrets.running_starts(F.col("x")).alias("s")).first()
    assert row.s == [sum(sizes[:i]) for i in range(n)]


def test_upper_tail(spark):
    zs = [-40.0, -8.0, -2.0, -0.5, 0.0, 0.3, 1.0, 1.99, 2.0, 2.01, 5.0, 12.0, 30.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", secrets.upper_tail(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(upper(min(r.z, 37.0)), rel=1e-9)


def test_query_digest(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    query = secrets._secrets(spark, sf_dir)
    assert "Python" not in query._jdf.queryExecution().toString() and "Arrow" not in query._jdf.queryExecution().toString()
    rows = query.collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = plain_base(docs[r.doc_id] or "")
        text = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b[1] == k for b in base) for k in range(3)]
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in text.split(",") if x]
