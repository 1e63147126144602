import os
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sweepframe.llm import lexicon, packing, pii, tokens

VOCABULARY = os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)
needs_files = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer files")


@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 9), max_size=3), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
@settings(max_examples=150, deadline=None)
def test_lexicon_is_a_map(words, others):
    lex = lexicon.Lexicon(lexicon.build(words))
    asked = list(words) + others
    found = lex.find(asked)
    assert sorted(found[: len(words)]) == list(range(len(words)))
    for w, k in zip(asked, found.tolist()):
        assert (k >= 0) == (w in words) and (k < 0 or lex.ids_of(k).tolist() == words[w])


def test_lexicon_shares_suffixes():
    words = {a + b"ing": [1] for a in (b"read", b"writ", b"join", b"merg")}
    assert int(lexicon.build(words)[2]) < sum(map(len, words)) - 6


@needs_files
@given(st.text(max_size=30).map(str.encode) | st.sampled_from([b"a" * 300, b"ab" * 200, bytes(range(256)) * 2]))
@settings(max_examples=100, deadline=None)
def test_long_and_short_merges_agree(word):
    rank = tokens.ranks(VOCABULARY)
    if word:
        assert tokens.merge(word, rank) == tokens.merge_long(word, rank)


TEXTS = ["", None, "Hello world", "  \n\n x  ", "naïve ﬁt – “quoted” … 😕 \x00", "don't we'll I'm", "<|endoftext|> is text", "日本語テキスト", "a" * 20_000, " " * 5_000 + "x", "1234567 3.14", "​﻿ é é"]


@needs_files
@pytest.mark.parametrize("words", [0, 5, 65_536])
def test_ids_equal_the_library(spark, words):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(tokens.TOKENIZERS, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = [(i, x) for i, x in enumerate(TEXTS + TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text", words=words).collect()}
    assert got == {i: t.encode(x, add_special_tokens=False).ids if x else [] for i, x in rows}
    sizes = {r.doc_id: r.n_tokens for r in tokens.encode(df, "doc_id", "text", words=words, counts_only=True).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


def test_first_fit_decreasing_equals_brute_force():
    r = random.Random(2)
    for _ in range(50):
        cap = r.randint(1, 30)
        sizes = [r.randint(0, cap) for _ in range(r.randint(0, 40))]
        room, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            k = next((k for k, left in enumerate(room) if left >= sizes[i]), len(room))
            room += [cap] * (k == len(room))
            room[k] -= sizes[i]
            want[i] = k
        assert packing.first_fit_decreasing(sizes, cap) == [want[i] for i in range(len(sizes))]


@pytest.mark.parametrize("group", [7, 1000])
def test_packing(spark, group):
    r = random.Random(1)
    rows = [(i, r.choice([0, 3, 50, 99, 100, 101, 250, 300])) for i in range(200)] + [(5, 40), (900, None)]
    df = spark.createDataFrame(rows, "doc_id long, n int").withColumn("budget_id", F.lit("clash"))
    out = packing.pack(df, "doc_id", "n", [(1, 100), (2, 1000), (3, None), (4, 0)], len(rows), group).collect()
    for b, cap in ((1, 100), (2, 1000)):
        own = [o for o in out if o.budget_id == b]
        load, total = {}, 0
        for o in own:
            load[o.container_id] = load.get(o.container_id, 0) + o.n_tokens
            total += o.n_tokens
        assert max(load.values()) <= cap and total == sum(n or 0 for _, n in rows)
        pieces = {}
        for o in own:
            pieces.setdefault(o.doc_id, []).append(o)
        for i, n in rows[:200]:
            if i != 5:
                assert len(pieces[i]) == max(1, -(-n // cap)) and {o.piece_from for o in pieces[i]} == {k * cap for k in range(len(pieces[i]))}
        assert len(pieces[5]) >= 2 and pieces[900][0].n_tokens == 0
    assert {o.budget_id for o in out} == {1, 2}
    used = {u.budget_id: u for u in packing.usage(spark.createDataFrame(out), [(1, 100), (2, 4096), (None, 5), (3, 0)]).collect()}
    for b, u in used.items():
        load = {}
        for o in out:
            if o.budget_id == b:
                load[o.container_id] = load.get(o.container_id, 0) + o.n_tokens
        assert (u.n_containers, u.fullest, u.least_containers) == (len(load), max(load.values()), -(-sum(load.values()) // u.capacity_tokens))
        assert abs(u.unused_share - (1 - sum(load.values()) / (u.capacity_tokens * len(load)))) < 1e-12 and u.fullest <= u.capacity_tokens
    assert packing.pack(df.limit(0), "doc_id", "n", [(1, 100)], 0).count() == 0


POST = """Hi Orla, mail me at orla.quist+lists@lab.example.org or orla [at] lab [dot] example.
SSN: 940-21-6160, passport no. XR1479908, grep -c '0155 755 296' x.csv gives 3, so the PHN is not unique.
Call +44 (0)20 7946 0294 or (503) 555-0104; seed 6710720611, isbn 900-1-5975-5052-12, 10.56.1.42, ZQ0001672, Ticket 604-5466.
Dr. Orla M. van Quistfield lives at 1453a Old Quarry Crescent Apt 70, PO Box 138 or 96, rue de Tamarind. @orla51 user@host:/tmp/x
"""


def test_mentions():
    names = pii.Names({"orla"}, {"hi", "call", "ticket", "mail", "me", "at", "lives"})
    got = {(k, POST[a:b]) for k, a, b in pii.find_all(POST, names)}
    assert got == {
        ("person_name", "Orla"), ("person_name", "Orla M. van Quistfield"), ("email", "orla.quist+lists@lab.example.org"), ("email", "orla [at] lab [dot] example"), ("id_number", "940-21-6160"), ("id_number", "XR1479908"),
        ("id_number", "0155 755 296"), ("phone", "+44 (0)20 7946 0294"), ("phone", "(503) 555-0104"), ("street_address", "1453a Old Quarry Crescent Apt 70"), ("street_address", "PO Box 138"), ("street_address", "96, rue de Tamarind"),
    }


@given(st.sets(st.text("abcdefABCDEF0123 -.@é", min_size=1, max_size=5), min_size=2, max_size=60))
@settings(max_examples=100, deadline=None)
def test_surrogates_keep_distinct_things_distinct(mentions):
    key = b"k" * 16
    out = {m: pii.surrogate("phone", m, key) for m in mentions}
    assert len(set(out.values())) == len(out)
    for m, s in out.items():
        assert len(m) == len(s) and re.sub(r"\d", "0", m).translate({}) [:0] == "" and all(a.isdigit() == b.isdigit() and a.isupper() == b.isupper() for a, b in zip(m, s))


def test_surrogates_of_names():
    key = b"secret"
    a, b = pii.surrogate("person_name", "Orla Quist", key), pii.surrogate("person_name", "ORLA QUIST", key)
    assert a.lower() == b.lower() and b.isupper() and a != "Orla Quist" and a[-1] == "t" and a == pii.surrogate("person_name", "Orla Quist", key)


def test_redaction_keeps_the_rest(spark):
    rows = [(1, POST), (2, None), (3, ""), (4, "nothing here"), (5, POST), (6, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash"))
    names = pii.word_lists(df, "text", ["Orla", None])
    got = {r.doc_id: r.text for r in pii.redact(df, "doc_id", "text", names, b"key").collect()}
    assert got[2] is None and got[3] == "" and got[4] == "nothing here" and got[6] == rows[5][1] and got[1] == got[5]
    found = {r.mention for r in pii.mentions(df, "doc_id", "text", names).where("doc_id = 1").collect()}
    assert found and not any(m in got[1] for m in found) and "isbn 900-1-5975-5052-12" in got[1]
    assert re.sub(r"\[(EMAIL|PHONE|ID_NUMBER|STREET_ADDRESS|PERSON_NAME) [^\n]*?\]", "", got[1]).count("\n") == POST.count("\n")
    assert pii.mentions(df.limit(0), "doc_id", "text", names).count() == 0


ANY_SCRIPT = ["Иван Петров", "ИВАН", "Γιώργος Παπαδόπουλος", "Ρω", "Žofie", "Søren Åkesson", "Éa", "Großmann", "ẞa", "Ed", "Al", "Ian", "Li", "José", "张伟", "김민준", "יוסי", "أحمد", "İı", "Ǆa", "ა", "A", "é"]


@pytest.mark.parametrize("kind", ["person_name", "street_address", "email", "id_number", "phone"])
def test_no_mention_of_any_script_survives(kind):
    for k in range(200):
        for m in ANY_SCRIPT + ["٣٤٥٦٧٨٩٠", "5"] * (kind != "person_name"):
            s = pii.surrogate(kind, m, b"key%d" % k)
            assert s != m and len(s) == len(m) and [c.isupper() for c in s] == [c.isupper() for c in m], (m, s)
    s = pii.surrogate("person_name", "Иван Петров", b"key")
    assert all(a != b for a, b in zip("Иван"[:1], s)) and re.fullmatch(r"[\u0400-\u04ff]+ [\u0400-\u04ff]+", s)


def test_every_letter_and_digit_moves_within_a_class_of_more_than_one():
    for c in map(chr, range(0x110000)):
        if c.isalpha() or c.isdecimal():
            own, k, capital = pii._place(c)
            assert len(own) > 1 and (own[k].upper() if capital else own[k]) == c


@given(st.sets(st.text("abАбВвΓγéÉßςİ٣1 -", min_size=1, max_size=4), min_size=2, max_size=60), st.sampled_from(["phone", "id_number", "street_address", "person_name"]))
@settings(max_examples=100, deadline=None)
def test_surrogates_of_other_scripts_stay_distinct(mentions, kind):
    assert len({pii.surrogate(kind, m, b"k") for m in mentions}) == len(mentions)


def test_a_frequent_surname_is_no_common_word(spark):
    rows = [(i, f"Ticket {i} is open and the tree of run {i} is short. " + ("Regards, Jane Keller" if i % 3 == 0 else "see you")) for i in range(300)] + [(900, "cc Jane Ticket 7 is closed, Jane Keller wrote. And Jane And so on")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = pii.word_lists(df, "text", ["Jane"])
    assert "keller" not in names.common and {"ticket", "tree", "and"} <= names.common
    got = pii.mentions(df, "doc_id", "text", names).collect()
    assert {r.mention for r in got if r.doc_id < 900} == {"Jane Keller"} and {r.mention for r in got if r.doc_id == 900} == {"Jane", "Jane Keller"}
    assert not any("Keller" in r.text for r in pii.redact(df, "doc_id", "text", names, b"key").collect())


def test_given_names_beyond_the_list_are_joined(spark, tmp_path, monkeypatch):
    from sweepframe.llm import plans

    names = ["".join("bcdfghjklm"[int(x)] + "aeiou"[int(x) % 5] for x in f"{i:03d}").capitalize() for i in range(60)]
    rows = [(i, f"we saw {n} Quistfield there, and {names[i - 1]} too; {n.upper()} is well") for i, n in enumerate(names)]
    rows += [(100 + i, f"thanks, {n} Orlando\n") for i, n in enumerate(["Zukavi", "Wexori", "Yptoni"] * 4)] + [(200, "so Zukavi and Wexori and Yptoni went"), (None, names[7]), (201, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n,) for n in [*names, None, ""]], "given_name string").write.parquet(f"{tmp_path}/given_names.parquet")
    want = {tuple(r) for r in plans.p9_found(spark, str(tmp_path)).collect()}
    text = {r.doc_id: r.text for r in plans.p9_redacted(spark, str(tmp_path)).collect()}
    assert {m for i, _, m in want if i == 200} == {"Zukavi", "Wexori", "Yptoni"} and len(want) == 3 * 60 + 12 + 3 + 1
    for bound in (1, 62):
        monkeypatch.setattr(pii, "LIST_WORDS", bound)
        assert {tuple(r) for r in plans.p9_found(spark, str(tmp_path)).collect()} == want
        assert {r.doc_id: r.text for r in plans.p9_redacted(spark, str(tmp_path)).collect()} == text


def test_coreference_over_formats():
    for k in range(50):
        sur = lambda kind, m: pii.surrogate(kind, m, b"key%d" % k)
        anna, schmidt = sur("person_name", "Anna"), sur("person_name", "Schmidt")
        assert sur("person_name", "Anna Schmidt") == f"{anna} {schmidt}" and sur("person_name", "SCHMIDT, Anna") == f"{schmidt.upper()}, {anna}"
        digits = lambda m: re.sub(r"\D", "", sur("phone", m))
        assert len({digits(m) for m in ("(503) 555-0104", "503-555-0104", "503.555.0104", "5035550104")}) == 1
        plain = digits("+49 30 901820")
        assert digits("+49 (0)30 90-18-20") == plain[:2] + "0" + plain[2:] and digits("0049 30/901820") == "00" + plain and digits("+4930901820") == plain
        mail = sur("email", "orla.quist+x@lab.example")
        name, domain = mail.split("@")
        assert sur("email", "Orla.Quist+x [at] lab [dot] example").lower() == f"{name} [at] {domain.split('.')[0]} [dot] {domain.split('.')[1]}"
        assert re.sub("-", "", sur("id_number", "940-21-6160")) == sur("id_number", "940216160")


@given(st.sets(st.text("0012+() -", min_size=3, max_size=7).filter(lambda m: m.strip("0+() -")), min_size=2, max_size=80))
@settings(max_examples=200, deadline=None)
def test_surrogates_of_phones_stay_distinct(mentions):
    out = {m: pii.surrogate("phone", m, b"k") for m in mentions}
    assert len(set(out.values())) == len(out)


@given(st.sets(st.lists(st.sampled_from(["a", "b", "o", "at", "dot", " at ", " dot ", "@", ".", "[at]", "-", "+"]), min_size=1, max_size=6).map("".join), min_size=2, max_size=60))
@settings(max_examples=100, deadline=None)
def test_surrogates_of_addresses_stay_distinct(mentions):
    assert len({pii.surrogate("email", m, b"k") for m in mentions}) == len(mentions)


def test_names_get_names_of_their_script_gender_and_case():
    for k in range(50):
        key = b"key%d" % k
        sur = lambda m, odd={}: pii.name_surrogate(m, key, odd)
        first, last = sur("Orla"), sur("Quist")
        assert sur("Orla Quist") == f"{first} {last}" and sur("QUIST, ORLA") == f"{last.upper()}, {first.upper()}" and sur("orla") == first.lower()
        assert first[-1] == "a" and sur("Orla", {"orla": ("m", 0)}).endswith(("o", "us", "an", "er"))
        assert re.fullmatch(r"[А-Я][а-я]+ [А-Я][а-я]+", sur("Иван Петров")) and re.fullmatch(r"[Α-Ω][α-ω]+", sur("Ρωμανός".replace("ό", "ο")))
        for m in ANY_SCRIPT + ["van der Berg", "O'Brien", "Mei-Ruo", "J. K. Rowle"]:
            assert all(a != b for a, b in zip(re.findall(r"[^\W\d_]+", m), re.findall(r"[^\W\d_]+", sur(m)))), (m, sur(m))


@pytest.mark.parametrize("bound", [20_000, 1])
def test_surrogates_of_names_are_checked_for_collisions(spark, monkeypatch, bound):
    """A small pool makes most draws collide: afterwards all parts have different names, none of them a real one."""
    monkeypatch.setattr(pii, "LIST_WORDS", bound)
    monkeypatch.setattr(pii, "SYLLABLES", {"LATIN": (["b", "d"], ["a", "o"], {"f": ["a"], "m": ["o"], "": ["e", "a"]})})
    firsts, lasts = ["Bada", "Orla", "Kim", "Dane", "Bodo"], [f"Quist{a}{b}" for a in "abcdef" for b in "ghijk"]
    rows = [(i, f"{'Mr' if f == 'Orla' else 'ask'} {f} {n} again") for i, (f, n) in enumerate((f, n) for f in firsts for n in lasts)]
    df = spark.createDataFrame([*rows, (None, "Mr Orla"), (900, None)], "doc_id long, text string")
    names = pii.Names({f.lower() for f in firsts}, {"again", "ask"})
    spans = pii._spans(df, "doc_id", "text", names)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(pii)  # workers see the small pool
    try:
        odd = {r.part: (r.gender, r.attempt) for r in pii.exceptional_names(spans, names.given, b"k").collect()}
        parts = {p.lower() for p in firsts + lasts}
        drawn = {p: pii.drawn_name(p, *odd.get(p, (pii.gender_of(p, 0, 0), 0)), b"k") for p in parts}
        assert len(set(drawn.values())) == len(parts) and not set(drawn.values()) & parts
        assert odd["orla"][0] == "m" and drawn["orla"].endswith("o")
        got = {r.doc_id: r.text for r in pii.redact(df, "doc_id", "text", names, b"k").collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(pii)
    for i, t in rows:
        _, f, n, _ = t.split(" ")
        assert got[i].split("[PERSON_NAME ")[1] == f"{drawn[f.lower()].capitalize()} {drawn[n.lower()].capitalize()}] again"
    assert got[900] is None and got[None] == f"Mr [PERSON_NAME {drawn['orla'].capitalize()}]"


def test_long_disguised_addresses_and_streets_are_found():
    names = pii.Names(set(), {"at", "write", "to", "lives"})
    long = "x" * 300
    text = f"write to {long}.y [at] {'lab-' * 80}z [dot] example [dot] org, lives 12 {'Old' * 90} {'Quarry' * 60} North Hill Road Apt 7"
    got = {(k, text[a:b]) for k, a, b in pii.find_all(text, names)}
    assert got == {("email", text[9 : text.index(", lives")]), ("street_address", text[text.index("12 ") :])}
