import random
import re

import pytest

from starflow.llm import pii

KEY = b"k"


@pytest.mark.parametrize("text,want", [
    ("mail a.b93@mail0.example.com now", [("email", "a.b93@mail0.example.com")]),
    ("call +1 (389) 555-5010 or +49 30 1234 5678.", [("phone", "13895555010"), ("phone", "493012345678")]),
    ("call 555-123-4567, 0301234567 or 030/1234567; not 2024-01-02-3333, 0.1234567890 or 1,0301234567", [("phone", "5551234567"), ("phone", "0301234567"), ("phone", "0301234567")]),
    ("at 10.0.0.255, not 300.1.1.1 nor 1.2.3.4.5", [("ip", "10.0.0.255")]),
    ("card 4111111111111111 and 4111 1111 1111 1111, not 4111111111111112", [("card", "4111111111111111")] * 2),
    ('token = "87e15d78b9d8ef29b6c10061e3551a60fa07e990" und', [("secret", "87e15d78b9d8ef29b6c10061e3551a60fa07e990")]),
    ("IBAN DE89 3704 0044 0532 0130 00 ok, DE88 3704 0044 0532 0130 00 no", [("iban", "DE89370400440532013000")]),
    ("Mrs. Anna Berg met Herr Müller and госпожа Иванова", [("given", "anna"), ("name", "berg"), ("name", "müller"), ("name", "иванова")]),
    ("Karl Lang slept. Anna Berg too", [("given", "karl"), ("name", "lang"), ("given", "anna"), ("name", "berg")]),
    ("Mr. Karl J. Lang wrote; then Lang slept, LANG said, but not Langer", [("given", "karl"), ("initial", "j."), ("name", "lang"), ("name", "lang"), ("name", "lang")]),
    ("Yesterday Jean-Paul O'Neil left. Big Words Here. The Big Ones", []), ("Yesterday Anna-Maria left", []),
    ("Version 2.0. In 2004, 12345678 words", []), ("", []),
])
def test_detection(text, want):
    assert [(m[2], m[3]) for m in pii.find(text)] == want


def test_gender():
    genders = lambda text: [m[4] for m in pii.find(text)]
    assert genders("Mrs. Kim Lee") == ["f", "f"] and genders("Paul Lee") == ["m", "n"] and genders("Dr. Mirela Popa") == ["n", "n"]
    assert genders("Анна Иванова, Иван Петров") == ["f", "f", "m", "m"]
    assert pii._gender("mirela", "", False) == "f"


def test_very_long_words_and_many_entities_take_linear_time():
    text = "a" * 300_000 + " a@b.cd " + "9" * 300_000 + " .x@y.zz a..b@c.de " + "ab." * 100_000 + "Mr. " + "A" * 100_000 + " Aa" * 50_000
    assert [m[3] for m in pii.find(text) if m[2] == "email"] == ["a@b.cd", "x@y.zz", "b@c.de"]
    assert len(pii.find(" ".join(f"u{i}@a.bc" for i in range(60_000)))) == 60_000


def test_formats():
    card = pii.surrogate("card", "4111111111111111", "n", 0, KEY)
    assert pii.luhn(card) and card != "4111111111111111" and card[0] == "4"
    assert pii.dress("card", "4111 1111-1111 1111", card)[4] == " "
    assert pii._iban_ok(pii.surrogate("iban", "DE89370400440532013000", "n", 0, KEY))
    assert re.fullmatch(r"[a-z]\.[a-z]\d\d@[a-z]{4}\d\.[a-z]{7}\.com", pii.surrogate("email", "a.b93@mail0.example.com", "n", 0, KEY))
    assert pii.surrogate("given", "anna", "f", 0, KEY).endswith(pii.ENDINGS["LATIN"]["f"])
    assert pii.script(pii.surrogate("name", "иванова", "f", 0, KEY)) == "CYRILLIC" and pii.surrogate("name", "иванова", "f", 0, KEY).endswith(pii.SURNAMES["f"])
    assert re.fullmatch("[a-z]+-[a-z]+", pii.surrogate("given", "anna-maria", "f", 0, KEY))
    assert len({pii.surrogate("initial", f"{c}.", "n", 0, KEY) for c in "abcdefghijklmnopqrstuvwxyz"}) == 26
    assert pii.dress("phone", "+1 (٣٨٩) 555-5010", "19876543210") == "+1 (٩٨٧) 654-3210"
    assert pii.dress("phone", "555-123-4567", "98765432101") == "987-654-32101"  # a surrogate that had to grow stays whole
    assert pii.dress("name", "LANG", "rona") == "RONA" and pii.dress("given", "Anna-Maria", "la-mina") == "La-Mina"


def slow(texts, key):
    """All texts with their surrogates, entity by entity, over plain dictionaries."""
    found = [pii.find(t) if t else [] for t in texts]
    genders = {}
    for spans in found:
        for _, _, kind, form, gender, _ in spans:
            genders.setdefault((kind, form), set()).add(gender)
    open_ = {e: min(g, key="mfn".index) for e, g in genders.items()}
    chosen = {e: pii.surrogate(*e, g, 0, key) for e, g in open_.items() if e[0] == "initial"}
    open_ = {e: g for e, g in open_.items() if e not in chosen}
    used, attempt = set(open_), 0
    while open_:
        winners = {}
        for (kind, form), gender in sorted(open_.items()):
            new = (kind, pii.surrogate(kind, form, gender, attempt, key))
            if new not in used:
                winners.setdefault(new, (kind, form))
        used |= set(winners)
        chosen |= {entity: new for (_, new), entity in winners.items()}
        open_ = {e: g for e, g in open_.items() if e not in chosen}
        attempt += 1
    out = []
    for text, spans in zip(texts, found):
        for start, stop, kind, form, _, _ in reversed(spans):
            text = text[:start] + pii.dress(kind, text[start:stop], chosen[kind, form]) + text[stop:]
        out.append((text, sum(s[5] for s in spans)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    people = ["Karl Lang", "Mr. Lang", "Mrs. Lang", "Anna Berg", "Dr. Kim Berg", "Berg", "Herr Otto K. Lang", "Иван Петров"]
    some = lambda: rng.choice([f"{rng.choice('abc')}@{rng.choice('ab')}.co", f"10.0.0.{rng.randrange(40)}", rng.choice(people), f"+1 (555) 555-{rng.randrange(1000, 1100)}", "plain", "Words"])
    texts = [" ".join(some() for _ in range(rng.randrange(30))) for _ in range(120)] + [None, "", "word " * 50_000 + "Karl Lang"]
    texts += [texts[3]] * 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.text, r.n_entities) for r in pii.pseudonymise(df, KEY).collect()}
    assert [got[i] for i in range(len(texts))] == slow(texts, KEY)
    assert not any("Karl Lang" in (t or "") for t, _ in got.values())


def test_registered_query_matches_brute_force(spark):
    from starflow.llm import queries

    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    want = slow([t for _, t in rows], b"key of the registered query")
    got = {r.doc_id: (r.text, r.n_entities) for r in queries.op9_pii_surrogates(spark, path).collect()}
    assert got == {i: w for (i, _), w in zip(rows, want)}


def test_pseudonymise(spark):
    texts = [f"see 10.0.{i}.1 and u{i}@a.bc or Mr. Karl Lang; again u{i}@a.bc, U1@A.BC" for i in range(60)] + [None, "", "clean 4111111111111112 text"]
    df = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x")], "doc_id long, text string, N_Entities string")
    rows = pii.pseudonymise(df, KEY).collect()
    assert len(rows) == len(texts) + 1
    by = {r.doc_id or 0: r for r in rows}
    assert by[60].text is None and by[61].text == "" and by[62].text == texts[62] and by[62].n_entities == 0
    assert sum(r.text == by[1].text for r in rows) == 2
    ips, mails, names, shared = set(), set(), set(), set()
    for i in range(60):
        ip, first, name, again, common = re.fullmatch(r"see (\S+) and (\S+) or Mr\. (.+); again (\S+), (\S+)", by[i].text).groups()
        assert first == again and by[i].n_entities == 5
        ips.add(ip), mails.add(first), names.add(name), shared.add(common)
    assert len(ips) == 60 and len(mails) == 60 and len(names) == 1 and len(shared) == 1
    assert not mails & {f"u{i}@a.bc" for i in range(60)} and not ips & {f"10.0.{i}.1" for i in range(60)}
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymise(df, b"")


def test_collisions_are_resolved(spark):
    forms = [(str(a), "n") for a in range(10, 40)]
    df = spark.createDataFrame([("ssn", f, g) for f, g in forms], "kind string, form string, gender string")
    got = pii.assign(df, b"k").collect()
    assert len(got) == 30 and len({r.surrogate for r in got}) == 30 and not {r.surrogate for r in got} & {f for f, _ in forms}
    assert len({pii.dress("ssn", r.form, r.surrogate) for r in got}) == 30
