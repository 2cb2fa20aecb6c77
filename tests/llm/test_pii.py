import hashlib
import random
import re

from helpers import ODD, ODD_IDS, documents

from lodestone.llm import pii

KINDS = ["email", "ip", "card", "phone"]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    spans = []
    for kind, pattern, ok in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    ):
        spans += [(m.start(), KINDS.index(kind), m.end(), kind) for m in re.finditer(pattern, text) if ok(m)]
    spans.sort()
    listed = [f"{k}:{s}:{e}" for s, _, e, k in spans]
    return [sum(k == x for *_, k in spans) for x in KINDS] + [hashlib.sha256(",".join(listed).encode()).hexdigest()], listed


def noise(seed):
    rng = random.Random(seed)
    parts = ["a@b.c", "a@b.c_d@e.f", "x.y+z@mail-1.example.com.", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "010.0000000000000000000000000000000000000000001.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+1..", "+12", "é", " ", "-", ".", "@", "+", "12", "_", "\n", "12345678901234567890123", "4111111111111111 12"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))


def test_base_matches_brute_force(spark):
    texts = [noise(i) for i in range(300)] + ODD + ["9" * 2000, "a" * 2000 + "@", "1 " * 2000, "a." * 1000 + "@b.c"]
    ids = list(range(1000, 1300)) + ODD_IDS + [50, 51, 52, 53]
    rows = pii.find_personal_data(documents(spark, texts, ids)).collect()
    want = sorted(str([i] + brute(t)[0]) for i, t in zip(ids, texts))
    assert sorted(str([r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256]) for r in rows) == want
    by_id = dict(zip(ids, texts))
    for r in rows:
        if r.doc_id not in (None, 7):
            assert set(brute(by_id[r.doc_id])[1]) <= set(filter(None, r.spans.split(",")))


def test_trees_add_what_looks_like_the_base(spark):
    rng = random.Random(3)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    texts = [f"call my phone +1 ({num(3)}) {num(3)}-{num(4)} now" for _ in range(150)]
    texts += [f"order {num(3)}.{num(3)},{num(5)} total" for _ in range(150)]
    extra = f"call my phone ({num(3)}) {num(3)}-{num(4)} now"
    rows = {r.doc_id: r.spans for r in pii.find_personal_data(documents(spark, texts + [extra, "clean text only"])).collect()}
    assert rows[300] == "local:14:28" and rows[301] == ""
    assert all(rows[i].startswith("phone:14:") and "," not in rows[i] for i in range(150))
    assert not any(rows[i] for i in range(150, 300))


def iban(rng):
    """A bank number whose checksum holds."""
    body = "".join(rng.choice("0123456789") for _ in range(18))
    check = 98 - int(body + "131400") % 97  # DE is 13 14
    return f"DE{check:02d}{body}"


def labelled_corpus(n=400):
    """Texts with genuine candidates in telling contexts, and look-alikes in others; what is genuine, by text."""
    rng = random.Random(6)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    texts, truth = [], []

    def add(before, value, after, genuine):
        texts.append(f"{before}{value}{after}")
        truth.append((len(before), len(before) + len(value)) if genuine else None)

    for i in range(n):
        add("call my phone ", f"+1 ({num(3)}) {num(3)}-{num(4)}", " now", True)
        add("order ", f"{num(3)}.{num(3)},{num(5)}", " total", False)
        add("account iban ", iban(rng), " please", True)
        add("order ", "DE" + num(20), " total", False)
        add("call ", f"({rng.randrange(2, 10)}{rng.randrange(9)}{rng.randrange(10)}) {rng.randrange(2, 10)}5{rng.randrange(10)}-{num(4)}", " today", True)
        add("invoice ", f"{num(3)}-{num(3)}-{num(4)}", ", page 2", False)
    return texts, truth


def test_each_generator_finds_what_is_genuine(spark):
    """Recall of added spans and their precision, each at least 0.9, by generator."""
    texts, truth = labelled_corpus()
    rows = pii.find_personal_data(documents(spark, texts)).collect()
    for kind in ("bank", "local"):
        found = {(r.doc_id, int(s.split(":")[1]), int(s.split(":")[2])) for r in rows for s in r.spans.split(",") if s.startswith(kind)}
        genuine = {(i, *t) for i, t in enumerate(truth) if t and i % 6 == {"bank": 2, "local": 4}[kind]}
        assert len(found & genuine) >= 0.9 * len(genuine) and len(found & genuine) >= 0.9 * len(found), (kind, len(found), len(genuine), len(found & genuine))
    assert sum(r.n_added for r in rows) == sum(len([s for s in r.spans.split(",") if s and s.split(":")[0] not in KINDS]) for r in rows)


def test_structures(spark):
    cases = {
        ("bank", "DE89 3704 0044 0532 0130 00"): True, ("bank", "GB82WEST12345698765432"): True, ("bank", "DE89 3704 0044 0532 0130 01"): False,
        ("government", "123-45-6789"): True, ("government", "666-45-6789"): False, ("government", "000-45-6789"): False, ("government", "912-45-6789"): False, ("government", "123-00-6789"): False, ("government", "123-45-0000"): False,
        ("local", "(212) 555-0123"): True, ("local", "112-555-0123"): False, ("local", "291.555.0123"): False, ("local", "212 155 0123"): False, ("local", "212-911-0123"): False,
        ("hardware", "00:1A:2b:3c:4d:5e"): True, ("hardware", "01:1A:2b:3c:4d:5e"): False, ("hardware", "00:1A-2b:3c:4d:5e"): False, ("hardware", "00:00:00:00:00:00"): False,
        ("spelled", "jane.doe [at] example [dot] org"): True, ("spelled", "see (at) figure (dot) whatever"): False, ("email", "a@b.c"): None, ("number", "123456"): None,
    }
    table = spark.createDataFrame([(i, k, h) for i, (k, h) in enumerate(cases)], "i int, kind string, hit string").withColumn("passes", pii.structure())
    assert {(r.kind, r.hit): r.passes for r in table.collect()} == cases
    for kind, hit in cases:
        assert "\\G" in pii.PATTERNS[kind] or re.search(pii.PATTERNS[kind], hit) or cases[kind, hit] is not True


def test_threshold_takes_chance_off():
    assert pii.threshold([(0.9, 100, 100), (0.7, 100, 50)], 0.0, False) == 0.9
    assert pii.threshold([(0.9, 100, 100), (0.7, 100, 96)], 0.0, False) == 0.7
    assert pii.threshold([(0.9, 100, 50)], 1 / 97, True) == 0.9 and pii.threshold([(0.9, 100, 50)], 1 / 97, False) == 2.0
    for passing_only in (True, False):
        assert pii.threshold([(0.9, 100, 57)], 0.57, passing_only) == 2.0  # what chance alone lets pass
        assert pii.threshold([(0.9, 100, 100), (0.6, 1000, 570)], 0.57, passing_only) == 0.9
        assert pii.threshold([], 0.5, passing_only) == pii.threshold([(0.4, 10, 10)], 0.0, passing_only) == 2.0


def test_suppression_matches_brute_force(spark):
    """Of what is added, spans that overlap a base span or an earlier one of those kept so far don't stay."""
    rng = random.Random(9)
    texts, _ = labelled_corpus(60)
    parts = ["(212) 555-0123", "212-555-0123 10", "+1 (212) 555-0123", "00:1A:2b:3c:4d:5e", iban(rng), "x", "1.2.3.4", "4111 1111 1111 1111", "jane [at] home [dot] org"]
    texts += [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 7))) for _ in range(60)]
    for r in pii.find_personal_data(documents(spark, texts)).collect():
        spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        added = [s for s in spans if s[2] not in KINDS]
        assert all(b <= c or d <= a for a, b, _ in added for c, d, k in spans if k in KINDS)
        assert all(x[1] <= y[0] for x, y in zip(added, added[1:]))


def test_long_runs_take_linear_time(spark):
    texts = ["9" * 500_000, "a" * 500_000 + "@", "1 " * 200_000, "a." * 200_000 + "@b.c", "1." * 200_000]
    rows = {r.doc_id: r for r in pii.find_personal_data(documents(spark, texts)).collect()}
    assert [rows[i].n_email for i in range(5)] == [0, 0, 0, 1, 0] and rows[4].n_ip == 50_000


def test_empty_table(spark):
    assert pii.find_personal_data(documents(spark, []).limit(0)).count() == 0
