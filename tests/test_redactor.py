"""Known names against brute force over both normal forms; which step keeps a stretch; words outside; numbers."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from factline.functions.masking import mask
from factline.operators import names, redactor
from factline.operators.redactor import Policy, Rule
from factline.streaming.holdback import restored


def by_hand(text, known):
    """Places by trying every name at every place, as words, in any case and either form."""
    out = {}
    for name in known:
        name = unicodedata.normalize("NFC", " ".join(name.split()))
        if not name:
            continue
        units = [f"(?:{re.escape(c)}|{re.escape(unicodedata.normalize('NFD', c))})" if c != " " else r"\s+" for c in name]
        pattern = re.compile("(?=(" + "".join(units) + "))", re.IGNORECASE)
        for m in pattern.finditer(text):
            a, b = m.start(1), m.end(1)
            word = lambda c: c.isalnum() or c == "_" or unicodedata.category(c)[0] == "M"
            if word(name[0]) and a and word(text[a - 1]) or word(name[-1]) and b < len(text) and word(text[b]):
                continue
            out[a] = max(out.get(a, 0), b)
    return sorted(out.items())


def test_places_equal_brute_force():
    r = random.Random(4)
    known = ["Zoé", "zoé müller", "Müller", "An", "An Na", "O'Neil", "-x-", "é", "Å b", "  ", ""]
    parts = ["Zoé", "Zoé", "ZOÉ", "Müller", "müller", "MÜLLER", " ", "  ", "\n", "An", "NA", "na", "o'neil", "-x-", ".", "é", "e", "́", "Å", "Å", "b", "_", "x"]
    found = names.automaton([names.formed_name(n) for n in known if names.formed_name(n)])
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        # a mark behind a letter it can't be composed with is part of that letter for both, so only the ends may differ there
        if re.search("[^eéuüA]́|^́|́́", text):
            continue
        assert names.places(text, found) == by_hand(text, known), repr(text)


def test_names_in_blocks_are_as_in_one(spark, monkeypatch):
    known = spark.createDataFrame([(f"Name {i}",) for i in range(60)] + [("Name 7 Ltd",), (None,), (" ",), ("NAME 7",)], "name string")
    docs = spark.createDataFrame([(1, "name  7 ltd and NAME 12, Name 121"), (2, None), (3, ""), (4, "x" * 200_000 + " Name 3")], "id int, text string")
    whole = {r.id: [tuple(p) for p in r.name_places] for r in names.with_places(docs, known).collect()}
    assert whole == {1: [(0, 11), (16, 23)], 2: [], 3: [], 4: [(200_001, 200_007)]}
    monkeypatch.setattr(names, "BLOCK_CHARS", 100)
    assert len(names.blocks(known)) > 3
    assert {r.id: [tuple(p) for p in r.name_places] for r in names.with_places(docs, known).collect()} == whole


def claims(spark, texts, policy, known=()):
    named = spark.createDataFrame([(n,) for n in known], "name string") if known else None
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("claims", F.lit("clash"))
    return [r.claims and [(c.label, c.value) for c in r.claims] for r in redactor.with_claims(docs, policy, named).orderBy("id").collect()]


def test_a_stretch_goes_to_the_first_step(spark):
    policy = Policy(("Credential", "Url", "Email"), (Rule("Own", "secret [a-z]+", "[own]"), Rule("Late", "Rowan [A-Z][a-z]+")))
    texts = ["mail rowan.quill@example.org or Rowan Quill", "https://u:Zr4p0p0p0@example.org/Rowan_Quill, Rowan Quill Rowan Ash", "a secret word by Rowan", None, "", "no claim"]
    assert claims(spark, texts, policy, ["Rowan Quill", "quill"]) == [
        [("Email", "rowan.quill@example.org"), ("known_names", "Rowan Quill")],
        # the credential splits the link, of which nothing is left to claim but what comes behind
        [("Credential", "Zr4p0p0p0"), ("known_names", "Rowan Quill"), ("Late", "Rowan Ash")],
        [("Own", "secret word")], None, [], [],
    ]


def test_numbers_addresses_links_and_dates(spark):
    policy = Policy(("Url", "PaymentCard", "IpAddress", "Phone"))
    texts = [
        "4111111111111111 4111 1111 1111 1111", "order 41111111111111112345678", "id a4111111111111111 and 4111111111111111ab", "4111111111111111Exp", "2001:db8::1. fe80::1%x 1.2.3.4.5 999.1.1.1 1.2.3.4",
        "(see https://h.org/a_(b)).", "[https://h.org/x] www. http:// me@host.tld/x host.tld/y", "+49 30 1234567, 0900-1700, 2026-10-05, (030) 123 4567, 0301234567 ext. 12",
    ]
    assert claims(spark, texts, policy) == [
        [("PaymentCard", "4111111111111111"), ("PaymentCard", "4111 1111 1111 1111")], [], [], [("PaymentCard", "4111111111111111")], [("IpAddress", "2001:db8::1"), ("IpAddress", "fe80::1"), ("IpAddress", "1.2.3.4")],
        [("Url", "https://h.org/a_(b)")], [("Url", "https://h.org/x"), ("Url", "host.tld/y")], [("Phone", "+49 30 1234567"), ("Phone", "(030) 123 4567"), ("Phone", "0301234567 ext. 12")],
    ]


def test_scrubbed_says_where(spark):
    policy = Policy(("Credential",), (Rule("Own", "n[0-9]+", "n0"),))
    docs = spark.createDataFrame([(1, "a n12 b n0 password=hunter2x"), (2, None)], "id int, text string")
    one, two = redactor.scrubbed(redactor.with_claims(docs, policy)).orderBy("id").collect()
    assert one.text == "a n0 b n0 password=[masked:secret-assignment]"
    assert [tuple(h) for h in one.hits] == [("Own", 2), ("Credential", 19)]
    assert (two.text, two.hits) == (None, [])
    counts = {r.label: r.found for r in redactor.claim_counts(redactor.with_claims(docs, policy)).collect()}
    assert counts == {"Own": 1, "Credential": 1}


def test_words_outside_and_cut_fragments(spark):
    docs = spark.createDataFrame(
        [(1, "b", "Rowan met Rowan-Lee, fooBar and snake_Case; _Quill_ API Jane's r@x.org Rowan@x.org"), (2, "b", "Rowan Quill and Quilliam Quilliam Quil"), (3, "b", "the Quilliam-Quil-"), (4, None, "Qu")],
        "id int, batch string, text string",
    )
    worded = redactor.with_words(redactor.with_claims(docs, Policy(("Email",))))
    assert [s.value for s in worded.filter("id = 1").first().words] == ["Rowan", "Rowan-Lee", "Quill", "Jane"]
    counts = redactor.word_counts(worded, "batch")
    assert {r.word: r.uses for r in counts.filter("batch = 'b'").collect()} == {"Rowan": 2, "Rowan-Lee": 1, "Quill": 2, "Jane": 1, "Quilliam": 2, "Quil": 1, "Quilliam-Quil": 1}
    assert [tuple(r) for r in redactor.cut_fragments(worded, counts, "batch", "id", 1).collect()] == [(2, "Quil")]


@pytest.mark.parametrize("n", [0, 1, 2])
def test_intervals_taken_out(n):
    r = random.Random(n)

    def spans(k):
        cuts = sorted(r.sample(range(60), 2 * k))
        return [{"start": a, "end": b} for a, b in zip(cuts[::2], cuts[1::2], strict=True)]

    for _ in range(300):
        a, b = spans(r.randrange(9)), spans(r.randrange(9))
        assert redactor.outside(a, b) == [s for s in a if not any(h["start"] < s["end"] and s["start"] < h["end"] for h in b)]
    assert redactor.outside(None, None) == []


def test_entities_masked(spark):
    rows = spark.createDataFrame([("a", ["a", "password=hunter2x", "password=hunter3x", None, "b"]), (None, ["b", "b"]), ("c", None)], "name string, aliases array<string>")
    found = [tuple(r) for r in names.masked_entities(rows, mask).collect()]
    assert found == [("a", ["password=[masked:secret-assignment]", "b"]), (None, ["b"]), ("c", None)]


def test_hidden_and_restored(spark):
    texts = ["mail a@x.org, b@x.org and a@x.org", "b@x.org [Email-1] [=Name-2] token=hunter2x", "[Email-", "", None, "a@x.org"]
    docs = spark.createDataFrame([(i, "q" if i == 5 else "p", t) for i, t in enumerate(texts)], "id int, batch string, text string")
    hidden, mapping = redactor.hidden(redactor.with_claims(docs, Policy(("Email", "Credential"))), "batch", "id")
    shown = {r.id: r.text for r in hidden.collect()}
    assert shown[0] == "mail [Email-1], [Email-2] and [Email-1]"
    assert shown[1] == "[Email-2] [=Email-1] [==Name-2] token=[masked:secret-assignment]"
    assert (shown[2], shown[3], shown[4], shown[5]) == ("[Email-", "", None, "[Email-1]")
    pairs = mapping.select(F.col("batch").alias("answer"), "placeholder", "value")
    back = restored(hidden.select("id", F.col("batch").alias("answer"), F.col("text").alias("shown")), pairs)
    assert {r.id: r.shown for r in back.collect()} == {i: t and t.replace("hunter2x", "[masked:secret-assignment]") for i, t in enumerate(texts)}


def test_many_names_meet_texts_by_equality(spark, monkeypatch):
    r = random.Random(9)
    known = ["Zoé", "zoé müller", "Müller", "An", "An Na", "O'Neil", "-x-", "é", "Å b", "é́", "́a", "#1", "Zoé 12 Ltd.", "x.", "²a"]
    parts = ["Zoé", "ZOÉ", "Müller", "müller", "MÜLLER", " ", "  ", "\n", "An", "NA", "na", "o'neil", "-x-", ".", "é", "e", "́", "Å", "Å", "b", "_", "x", "#1", "12", "Ltd", "²", "a", "1"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(3000)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    some = spark.createDataFrame([(n,) for n in known], "name string")
    whole = {x.id: [tuple(p) for p in x.name_places] for x in names.with_places(docs, some).collect()}
    seen = []
    monkeypatch.setattr(names, "BLOCK_CHARS", 20)
    monkeypatch.setattr(names, "_marked", lambda docs, block, *rest, real=names._marked: (seen.extend(block.value), real(docs, block, *rest))[1])
    assert {x.id: [tuple(p) for p in x.name_places] for x in names.with_places(docs, some).collect()} == whole
    assert sorted(seen) == sorted(map(names.formed_name, ["é́", "́a"]))  # only what can begin or end inside a word is looked for by automata


def test_spans_are_python_objects_for_a_few_rows_at_a_time():
    batch = redactor.pa.RecordBatch.from_arrays([redactor.pa.array(range(130))], names=["a"])
    assert [b.num_rows for b in redactor._few(iter([batch, batch.slice(0, 0)]))] == [64, 64, 2]
