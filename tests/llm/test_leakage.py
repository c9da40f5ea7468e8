import itertools
import random

import pytest

from spanforge.llm import leakage as k

WORDS = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]
ITEM, DOC = "item_id bigint, passage string, doc_id bigint", "doc_id bigint, text string, item_id bigint"


def passage(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], DOC)
    p = spark.createDataFrame([(i, t, 0) for i, t in items], ITEM)
    return sorted(tuple(r) for r in k.leaks(d, p, **kw).collect())


def test_cases(spark):
    rng = random.Random(1)
    a, b = passage(rng, 60).split(), passage(rng, 50).split()
    edited = list(a)
    for i in range(4, 60, 9):
        edited[i] = "changed"
    lost = [w for i, w in enumerate(a) if i % 10 != 5]
    too_many = [("changed" if i % 5 == 2 else w) for i, w in enumerate(a)]
    mixed = " ".join(a[20:40]).replace("wa", "<b>WА</b>").replace(" ", " \n", 3)  # a Cyrillic A
    filler = passage(random.Random(9), 300)
    docs = [
        (1, filler + " " + " ".join(a) + " " + filler), (2, " ".join(a[10:25])), (3, " ".join(a[10:24])), (4, filler + " " + " ".join(edited)), (5, " ".join(lost)),
        (6, " ".join(too_many)), (7, mixed), (8, ", ".join(w.upper() for w in a[5:30])), (9, None), (10, ""), (11, " ".join(a[:20] + b[:20])), (12, "short one here"), (13, " ".join(a)), (13, " ".join(a)),
    ]
    items = [(1, " ".join(a)), (2, " ".join(a)), (3, " ".join(b)), (4, None), (5, ""), (6, "Short one, here."), (7, "x")]
    got = run(spark, docs, items)
    assert got == sorted([(d, i) for d in (1, 2, 4, 5, 7, 8, 11, 13) for i in (1, 2)] + [(11, 3), (12, 6)])
    assert run(spark, [], items) == [] and run(spark, docs, []) == []


def test_same_build_is_no_leak(spark):
    text = "in the early cortex of mice levels of {} rise {} fold and {} binds the late promoter of the kinase in all treated cells"
    item = text.format("AB12", "3", "AB12")
    docs = [(1, text.format("XY9", "3", "XY9")), (2, item), (3, text.format("AB12", "7", "AB12")), (4, text.format("TNF", "3", "TNF")), (5, text.format("AB12", "3", "EGF"))]
    assert run(spark, docs, [(1, item)]) == [(2, 1), (3, 1), (5, 1)]
    short = "in the early cortex of adult mice the level of TNF rises early while all other kinases of the late pathway fall"
    assert run(spark, [(1, short.replace("TNF", "EGF")), (2, short.replace("pathway", "cascade"))], [(1, short)]) == [(2, 1)]


def test_repeated_shingles(spark):
    p = "wa wb wc wd " * 8 + "we wf"
    docs = [(1, "x y " + "wa wb wc wd " * 5), (2, "wa wb wc wd " * 3), (3, p)]
    assert run(spark, docs, [(1, p)]) == [(1, 1), (3, 1)]


def test_changed_numbers_count_as_changes(spark):
    rng = random.Random(4)
    words = passage(rng, 40).split()
    words[9], words[18], words[20], words[30] = "12", "TNF", "7", "8"
    swapped = ["13" if i == 9 else "9" if i == 20 else w for i, w in enumerate(words)]
    assert run(spark, [(1, " ".join(swapped))], [(1, " ".join(words))]) == [(1, 1)]


def test_markup_and_short_items(spark):
    rng = random.Random(5)
    p = passage(rng, 20).split()
    inside = " ".join(p[:8]) + ' <a href="' + "x" * 500 + '" class=y>' + " ".join(p[8:12]) + "</a> &nbsp;<br/>" + " ".join(p[12:])
    odd = ["a < b and c > d", "<", "<a", "<a b=" * 50_000, "<|x|>"]
    docs = [(1, inside), *enumerate(odd, 2), (20, "只有短句在这里。"), (21, "短句")]
    assert run(spark, docs, [(1, " ".join(p)), (2, "短句"), (3, "d"), (4, "！？")]) == [(1, 1), (2, 3), (20, 2), (21, 2)]


def test_letters(spark):
    rng = random.Random(2)
    p = "".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(120))
    docs = [(1, "前" + p[30:70] + "后"), (2, "前" + p[30:69] + "后"), (3, "。".join(p[i : i + 5] for i in range(0, 60, 5))), (4, p[:30] + "改" + p[31:60]), (5, p[100:])]
    assert run(spark, docs, [(1, p), (2, p[100:110])]) == [(1, 1), (3, 1), (5, 2)]


def units(words):
    return k.words_of(" ".join(words))


def found(item, doc):
    kind, size, own = k.item_units(" ".join(item))
    return k.Document(kind, units(doc)).holds(size, own)


@pytest.mark.parametrize("seed", range(30))
def test_prefix_loses_nothing(seed):
    """Whatever holds an item shares one of its prefix shingles, in any order of rarity."""
    rng = random.Random(seed)
    item = passage(rng, rng.randrange(10, 70)).split()
    n = rng.randrange(min(8, len(item)), len(item) + 1)
    a = rng.randrange(len(item) - n + 1)
    part = item[a : a + n]
    for _ in range(rng.randrange(0, n // 7 + 1)):
        at = rng.randrange(len(part))
        part[at : at + 1] = rng.choice([[], ["new"], [part[at], "new"]])
    doc = passage(rng, 30).split() + part + passage(rng, 30).split()
    if found(item, doc):
        codes = k.shingles(units(item) >> 1, k.SHINGLE).tolist()
        met = set(k.shingles(units(doc) >> 1, k.SHINGLE).tolist())
        for _ in range(20):
            rank = [(rng.randrange(4), c) for c in codes]
            assert met & {codes[i] for i in k.prefix_places(rank, "w", len(item))}


@pytest.mark.parametrize("length", [15, 16, 18, 20, 24])
def test_changes_near_the_ends(length):
    """A stretch with one word in eight replaced counts wherever they stand, its first and last word kept."""
    words = [f"v{i}x" for i in range(length + 20)]
    item = [w.translate(str.maketrans("0123456789", "abcdefghij")) for w in words]
    around = [f"z{c}" for c in "abcdefgh"]
    for at in itertools.combinations(range(1, length - 1), length // 8):
        part = [("other" if i in at else w) for i, w in enumerate(item[10 : 10 + length])]
        assert found(item, around + part + around), at
    part = [("other" if i in (1, 4, 7, 10, 13) else w) for i, w in enumerate(item[10 : 10 + length])]
    assert not found(item, around + part[:14] + around)


def brute(item, doc):
    """Edit distances of every pair of stretches, one start after another."""
    n = len(item)
    for x, y in itertools.product(range(n), range(len(doc))):
        if item[x] != doc[y]:
            continue
        row = list(range(len(doc) - y + 1))
        for i in range(x, n):
            last, row = row, [row[0] + 1]
            for b in range(1, len(doc) - y + 1):
                same = item[i] == doc[y + b - 1]
                row.append(min(last[b - 1] + (not same), last[b] + 1, row[b - 1] + 1))
                length = i - x + 1
                if same and (length >= min(15, n) and row[b] * 8 <= length or (row[b] + x + n - 1 - i) * 8 <= n):
                    return True
    return False


@pytest.mark.parametrize("seed", range(40))
def test_against_edit_distances(seed):
    rng = random.Random(seed)
    item = [rng.choice(WORDS) for _ in range(rng.randrange(10, 45))]
    n = rng.randrange(min(12, len(item)), len(item) + 1)
    a = rng.randrange(len(item) - n + 1)
    part = item[a : a + n]
    for _ in range(n // 8 + rng.randrange(2)):
        at = rng.randrange(len(part))
        part[at : at + 1] = rng.choice([[], ["new"], [part[at], "new"]])
    doc = [rng.choice(WORDS) for _ in range(8)] + part + [rng.choice(WORDS) for _ in range(8)]
    assert found(item, doc) == brute(item, doc)
