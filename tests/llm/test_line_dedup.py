import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from locusloom.llm import line_dedup


def shingles(line):
    return {line[i : i + 8] for i in range(len(line) - 7)}


def plain(docs):
    """Kept text per (doc_id, text), comparing every two lines."""
    spots = [(i, t, p, x.strip(" \t\r")) for i, t in docs for p, x in enumerate((t or "").split("\n"))]
    spots = [s for s in spots if s[3]]
    lines = sorted({s[3] for s in spots})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(x) for x in lines]
    for i, a in enumerate(lines):
        for b, y in zip(lines[:i], sets[:i], strict=True):
            x = sets[i]
            if x and y and 0.8 * max(len(x), len(y)) <= min(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
                root[find(a)] = find(b)
    seen, gone = set(), set()
    for i, t, p, x in sorted(spots, key=lambda s: (s[0], s[2])):
        if find(x) in seen:
            gone.add((i, p))
        seen.add(find(x))
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in docs}


def fuzzy_documents(seed=5, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    pool = [[word() for _ in range(rng.randint(1, 40))] for _ in range(60)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 3])):
                words[rng.randrange(len(words))] = word()
            lines.append(" ".join(words) + rng.choice(["", " ", "\r"]))
        docs.append((i, "\n".join(lines)))
    return docs


def test_matches_brute_force(spark):
    docs = fuzzy_documents()
    got = line_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))
    want = plain(docs)
    wrong = [r.doc_id for r in got.collect() if r.text != want[r.doc_id]]
    assert len(wrong) <= 1  # banding may miss a pair close to the threshold


def test_keys_agree_with_spark(spark):
    lines, keys = line_dedup.batch_lines(pa.array([" été 1\nb\r", None, "b\n\n "]))
    rows = spark.createDataFrame([(x,) for x in lines.to_pylist()], "line string").select("line", F.xxhash64("line")).collect()
    assert dict(zip(lines.to_pylist(), keys.tolist(), strict=True)) == dict(map(tuple, rows))


def test_large_groups_and_bands(spark):
    """Hundreds of variants of one line, and one line in every document, leave one each."""
    rng = random.Random(2)
    base = [f"word{i}x" for i in range(120)]
    docs = []
    for i in range(400):
        words = list(base)
        words[rng.randrange(120)] = "other"
        docs.append((i, "the line of all documents\n" + " ".join(words) + f"\nunique number {i} {rng.random()}"))
    got = line_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(16)).collect()
    kept = {r.doc_id: r.text.split("\n") for r in got}
    assert len(kept[0]) == 3 and all(len(x) == 1 for i, x in kept.items() if i)


def family(n=2000, seed=3):
    """Lines of one template at Jaccard of about 0.5 to 0.7 to each other; half of them have a copy or two at 0.8 or more."""
    rng = random.Random(seed)
    base = [f"part{i:02d}" for i in range(40)]
    number = lambda: f"{rng.randrange(10**6):06d}"
    out = []
    while len(out) < n:
        words = list(base)
        for at in rng.sample(range(40), 3):
            words[at] = number()
        out.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 2])):
            near = list(words)
            near[rng.randrange(40)] = number()
            out.append(" ".join(near))
    rng.shuffle(out)
    return out[:n]


def first_of_each(lines):
    """Indexes of the lines that stay, from the overlaps of every two lines."""
    sets = [shingles(x) for x in lines]
    often = [x for x, n in Counter(x for s in sets for x in s).items() if n > 1]
    ids = {x: i for i, x in enumerate(often)}
    has = np.zeros((len(sets), len(ids)), np.float32)
    for i, s in enumerate(sets):
        has[i, [ids[x] for x in s if x in ids]] = 1
    both, size = has @ has.T, np.array([len(s) for s in sets])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in np.argwhere(both >= 0.8 * (size[:, None] + size - both)):
        low, high = sorted((find(i), find(j)))
        root[high] = low
    return {find(i) for i in range(len(sets))}


def test_family_of_mixed_similarity_matches_brute_force(spark):
    """Fuzzy copies inside a family whose hubs are like few of them."""
    lines = family()
    want = first_of_each(lines)
    assert 500 < len(want) < 1500
    got = line_dedup.deduplicate(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id for r in got if r.n_kept} == want


def test_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    got = line_dedup.deduplicate(docs)
    assert set(got.columns) == {*docs.columns, "n_lines", "n_kept"}
    rows = got.collect()
    assert len(rows) == len(odd_rows)
    by = {(r.doc_id, r.source): r for r in rows}
    assert by[1, "a"].text is None and by[2, "a"].text == "" and by[3, None].text == "  \n\t "
    assert by[7, "c"].n_kept == 2 and by[8, None].text == "" and by[8, None].n_kept == 0
    assert line_dedup.deduplicate(documents([])).count() == 0


def test_shingles_are_those_of_the_text():
    """Numbers of shingles agree with plain sets, for few characters, many, and those beyond 16 bits."""
    rng = random.Random(4)
    many = "".join(map(chr, range(0x4E00, 0x4E00 + 900)))
    for letters in ("ab", "abcdeé", "aбвгд", many, many + "".join(chr(0x20000 + i) for i in range(70_000))):
        for _ in range(30):
            lines = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 7, 8, 9, 60]))) for _ in range(rng.randint(1, 5))]
            lines += [x[2:] + x[:30] for x in lines]
            got, want = line_dedup.shingles(lines), [shingles(x) for x in lines]
            assert [len(x) for x in got] == [len(x) for x in want]
            both = line_dedup._overlaps(got)
            for i, x in enumerate(want):
                for j, y in enumerate(want[:i]):
                    assert line_dedup.common(got[i], got[j]) == both[i, j] == len(x & y)


def test_lines_of_a_band_meet_without_python(spark):
    """The rows of all bands, a dozen for each line, do not pass through Python a second time."""
    docs = spark.createDataFrame(fuzzy_documents(n=5), "doc_id long, text string")
    assert line_dedup.candidates(docs)._jdf.queryExecution().executedPlan().toString().count("MapInArrow ") == 1


def test_many_scripts_match_brute_force(spark):
    """Lines of more characters than a byte holds, some equal but for a few characters."""
    rng = random.Random(8)
    letters = "".join(map(chr, range(0x4E00, 0x4E00 + 500)))
    base = ["".join(rng.choice(letters) for _ in range(120)) for _ in range(10)]
    docs = []
    for i in range(60):
        line = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 5])):
            line[rng.randrange(120)] = rng.choice(letters)
        docs.append((i, "".join(line) + "\nзаголовок " + str(i % 3)))
    got = line_dedup.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    want = plain(docs)
    assert sum(r.text != want[r.doc_id] for r in got) <= 1


def test_session_keeps_the_usual_batches(spark):
    """The larger batches hold for the operator's own steps only."""
    line_dedup.deduplicate(spark.createDataFrame(fuzzy_documents(n=5), "doc_id long, text string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "500"
