import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reconcile.llm import surrogates
from reconcile.llm.queries import op1_surrogates
from reconcile.llm.surrogates import Surrogates, find, in_format, luhn, replace, script_of
from tests.llm.cases import SF_DIR, as_dicts, awkward, documents, nothing

KEY = b"test"


def _kinds(text):
    return [(m.kind.split()[0], text[m.start : m.end]) for m in find(text)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("mail a.b+c@Mail5.example.com.", [("email", "a.b+c@Mail5.example.com")]),
        ("MAI.44@MAIL5.EXAMPLE.COM!!", [("email", "MAI.44@MAIL5.EXAMPLE.COM")]),
        ("+1 (017) 555-7713 and 017-555-7713", [("phone", "+1 (017) 555-7713"), ("phone", "017-555-7713")]),
        ("from 97.51.17.173 to", [("ip", "97.51.17.173")]),
        ("version 2.0.1 of 999.1.1.1 or 1.2.3.4.5", []),
        ("9807915762804490, 7536784127813050, 4111 1111 1111 1112 and 4111 1111 1111 1111", [("card", "4111 1111 1111 1111")]),
        ('TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', [("secret", "9233A8ECF7C5B09FE5949719B6B82BC439E9329B")]),
        ("ssn 123-45-6789", [("ssn", "123-45-6789")]),
        ("DE89 3704 0044 0532 0130 00", [("iban", "DE89 3704 0044 0532 0130 00")]),
        ("Mrs. Anna Schmidt met Dr Jones", [("given", "Anna"), ("surname", "Schmidt"), ("surname", "Jones")]),
        ("MARY SMITH", [("given", "MARY"), ("surname", "SMITH")]),
        ("Елена Петрова", [("given", "Елена"), ("surname", "Петрова")]),
        ("In 1998, 12 of 345 came; pages 10-20, ISBN, 3.14159", []),
        ("", []),
    ],
)
def test_mentions(text, expected):
    assert _kinds(text) == expected


def test_replacement_is_consistent_and_in_format():
    s = Surrogates(KEY)
    text = "a.b@x1.com A.B@X1.COM +1 (017) 555-7713 +1 017 555 7713 Mary Smith MARY SMITH 10.0.0.7 4111111111111111"
    new, found = replace(text, s, {})
    words = [new[m.start : m.end] for m in found]
    assert words[0].upper() == words[1] and words[0] != "a.b@x1.com"
    assert re.sub(r"\D", "", words[2]) == re.sub(r"\D", "", words[3])
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", words[2])
    assert words[4].upper() == words[6] and words[5].upper() == words[7]
    assert words[4] in surrogates.GIVEN["latin", "f"].split()
    assert words[8].startswith("10.") or words[8].startswith("1")
    assert luhn(words[9]) and words[9] != "4111111111111111"
    for original in ("a.b@x1.com", "7713", "Smith", "4111111111111111"):
        assert original not in new


def test_scripts_and_genders_stay():
    s = Surrogates(KEY)
    for (script, gender), names in surrogates.GIVEN.items():
        drawn = [s.of(f"given {script} {gender}", n) for n in names.split()]
        assert sorted(drawn) == sorted(names.split())
        assert all(a != b for a, b in zip(drawn, names.split(), strict=True))
        assert script_of(s.of(f"surname {script}", "Xyz")) == script


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["card", "phone", "ssn", "secret"]), st.text("0123456789", min_size=9, max_size=19))
def test_forms_stay(kind, digits):
    new = Surrogates(KEY).of(kind, digits)
    assert re.fullmatch(r"\d+", new) or kind == "secret"
    assert len(new) == len(digits)
    if kind == "card":
        assert luhn(new) == luhn(digits)


def test_surrogates_of_a_form_are_distinct():
    s = Surrogates(KEY)
    for kind, entities in {
        "ssn": [f"{i:04d}" for i in range(10_000)],
        "ip": [f"10.0.{i}.{j}" for i in range(8) for j in range(256)],
        "email": [f"{a}{i}@h{i % 7}.org" for a in "abc" for i in range(500)],
        "card": [f"{i:013d}" for i in range(3000)],
    }.items():
        assert len({s.of(kind, e) for e in entities}) == len(entities)
    assert s.of("ssn", "0001") != Surrogates(b"other").of("ssn", "0001")


def test_colliding_surrogates_are_drawn_again(spark):
    """A form of so few values that most surrogates are entities of the corpus themselves."""
    rows = [("ssn", f"{i:02d}") for i in range(30)] + [("surname latin", f"Name{chr(97 + i)}") for i in range(26)]
    df = spark.createDataFrame(rows, "kind string, entity string")
    attempts = {(r["kind"], r["entity"]): r["attempt"] for r in as_dicts(surrogates.redrawn(df, KEY))}
    assert attempts
    s = Surrogates(KEY)
    drawn = [(k, s.of(k, e, attempts.get((k, e), 0))) for k, e in rows]
    assert len(set(drawn)) == len(rows)
    assert not set(drawn) & set(rows)


@pytest.mark.parametrize("most_shared", [0, 100_000])
def test_all_documents_agree(spark, most_shared):
    numbers = [f"{i:09d}" for i in range(0, 40)]
    texts = [f"call 0{n[:2]}-{n[2:5]}-{n[5:]} now, {n[:3]}-{n[3:5]}-{n[5:]}" for n in numbers] * 2
    docs = spark.createDataFrame([(i % 50, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, entities string")
    got = as_dicts(surrogates.pseudonymize(docs, KEY, most_shared=most_shared, entities="found"))
    assert len(got) == len(texts) and {r["entities"] for r in got} == {"x"}
    assert len({r["text"] for r in got}) == len(numbers)
    real = set(re.findall(r"\d{3}-\d\d-\d{4}", " ".join(texts)))
    assert not real & set(re.findall(r"\d{3}-\d\d-\d{4}", " ".join(r["text"] for r in got)))


def test_awkward_rows(spark):
    docs = awkward(spark)
    got = surrogates.pseudonymize(docs, KEY)
    assert got.columns == [*docs.columns, "entities"]
    before, after = as_dicts(docs), as_dicts(got)
    assert sorted(str((r["doc_id"], r["text"])) for r in before) == sorted(str((r["doc_id"], r["text"])) for r in after)
    assert surrogates.pseudonymize(nothing(spark), KEY).count() == 0


def test_query_leaves_no_entity_and_changes_nothing_else(spark):
    got = {r["doc_id"]: r for r in as_dicts(op1_surrogates(spark, SF_DIR))}
    pairs = {}
    for d in documents():
        text, row = d["text"] or "", got[d["doc_id"]]
        mentions = find(text)
        assert len(row["entities"]) == len(mentions)
        at = 0
        for m, e in zip(mentions, row["entities"], strict=True):
            assert row["text"][: e["start"]][-5:] == text[: m.start][-5:] or at
            new = row["text"][e["start"] : e["end"]]
            assert new != text[m.start : m.end]
            pairs.setdefault((m.kind, m.entity), set()).add(re.sub(r"[\W_]", "", new).lower())
            at = 1
        if not mentions:
            assert row["text"] == d["text"]
    assert all(len(v) == 1 for v in pairs.values())
    kinds = {}
    for (kind, _), v in pairs.items():
        kinds.setdefault(kind, []).extend(v)
    assert all(len(v) == len(set(v)) for v in kinds.values())
    assert len(pairs) > 10


def test_written_as_mentioned():
    assert in_format("+10175557713", "+1 (999) 111-2222", "phone") == "+1 (017) 555-7713"
    assert in_format("Kalo", "SMITH", "surname latin") == "KALO"


def test_full_forms_are_permuted(spark):
    """Forms with all, most or too many of their values among the entities, and values of marks only."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("ssn", f"{i:02d}") for i in range(100)] + [("phone", f"+1{i:03d}") for i in range(700)]
    rows += [("email", f"{a}@{b}.com") for a in letters for b in letters[:20]] + [("iban", f"DE{i}") for i in range(10)]
    rows += [("secret", "--------"), ("secret", "-------_"), ("email", "_@-.com"), ("secret", "1-------")]
    rows += [("surname latin", f"Name{a}") for a in letters]
    df = spark.createDataFrame(rows, "kind string, entity string")
    attempts = {(r["kind"], r["entity"]): r["attempt"] for r in as_dicts(surrogates.redrawn(df, KEY))}
    s = Surrogates(KEY)
    drawn = {(k, e): s.of(k, e, attempts.get((k, e), 0)) for k, e in rows}
    assert len({(k, new) for (k, _), new in drawn.items()}) == len(rows)
    assert all(new != e for (_, e), new in drawn.items())
    for (k, e), new in drawn.items():
        full = k in ("ssn", "phone", "iban") or (k == "email" and e != "_@-.com")
        assert (attempts.get((k, e)) == surrogates.FULL) == full
        if full:
            assert surrogates.form_of(k, new) == surrogates.form_of(k, e)
        else:
            assert (k, new) not in drawn


def test_full_draws_of_cards_and_addresses():
    s = Surrogates(KEY)
    for kind, entities in {
        "card": [f"{i:013d}" for i in range(500)],
        "ip": [f"192.168.{i}.{j}" for i in range(2) for j in range(50)],
    }.items():
        new = [s.of(kind, e, surrogates.FULL) for e in entities]
        assert len(set(new)) == len(new) and all(a != b for a, b in zip(new, entities, strict=True))
        assert [surrogates.form_of(kind, n) for n in new] == [surrogates.form_of(kind, e) for e in entities]


def test_short_numbers_with_a_plus():
    """A number with a plus and fewer than seven digits is no phone number."""
    assert _kinds("add +12345 or +1 23 45") == []
    assert _kinds("call +1234567 or +683 4002") == [("phone", "+1234567"), ("phone", "+683 4002")]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Mary Smith called. Later Smith wrote, and MARY too.", ["Mary", "Smith", "Smith", "MARY"]),
        ("Then Smith came: Mary Smith's book", ["Smith", "Mary", "Smith"]),
        ("Mary Jane Smith left", ["Mary", "Jane", "Smith"]),
        ("Mary Anna Smith left", ["Mary", "Anna", "Smith"]),
        ("Dr. Olivia Brown and Brown's dog", ["Olivia", "Brown", "Brown"]),
        ("Mary\nSmith and Mary  Smith and Dr.\n  Jones", ["Mary", "Smith", "Mary", "Smith", "Jones"]),
        ("John F. Kennedy met Ursula von der Leyen", ["John", "Kennedy", "Ursula", "Leyen"]),
        ("MARY JANE SMITH, Smith", ["MARY", "JANE", "SMITH", "Smith"]),
        ("Mary Smith Anna Jones Dr Brown", ["Mary", "Smith", "Anna", "Jones", "Brown"]),
        ("I saw Mary\nThe end", []),
        ("Mary Smith The end. The Smithsonian, smith, Smith_1", ["Mary", "Smith"]),
    ],
)
def test_all_words_of_a_name_wherever_they_stand(text, expected):
    mentions = find(text)
    assert [text[m.start : m.end] for m in mentions] == expected
    by_word = {}
    for m in mentions:
        by_word.setdefault(text[m.start : m.end].lower(), set()).add((m.kind, m.entity))
    assert all(len(entities) == 1 for entities in by_word.values())
    new, _ = replace(text, Surrogates(KEY), {})
    assert not any(re.search(rf"(?<!\w){word}(?!\w)", new) for word in {"Smith", "SMITH", "Jane", "Brown", "Kennedy"})
