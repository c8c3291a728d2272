"""The training-data operators against brute force, round trips and planted cases."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import at, write_tables
from textward.llm import p1_near_copies as p1
from textward.llm import p3_personal, p4_lookalike_pairs, p5_abuse, p6_format_copies, p7_packing, p8_mixing, p9_garbled
from textward.llm.fields import parse_fields
from textward.llm.fuzzy_lexicon import FuzzyLexicon
from textward.llm.lookalike import Rewriter

WORDS = "alder basin copper delta ember fjord garnet hollow island juniper kettle lantern meadow needle orchard pebble quarry ridge saddle timber upland valley willow yonder zephyr anchor bridge castle dagger engine".split()


def request(i, text, **more):
    return {"request_id": i, "text": text, "direction": "input", "ts": at(i), "received_at": at(i), **more}


@pytest.fixture(scope="module")
def rewrite():
    return Rewriter(Counter("plain letters of a usual text, more Latin than anything else" * 9))


def test_consistent_form(rewrite):
    for raw, plain in [
        ("ｆｕｌｌ ｗｉｄｔｈ １２", "full width 12"),
        ("сору thе tехt", "copy the text"),
        ("résumé", "résumé"),
        ("a​b­c﻿", "abc"),
        ("thin no break　", "thin no break "),
        ("𝐩𝐨𝐥𝐢𝐭𝐞 ﬁx", "polite fix"),
        ("Тема вчера", "Тема вчера"),
        ("ТЕМА ВЧЕРА", "ТЕМА ВЧЕРА"),
        ("Keep CASE, accents é and: punctuation!", "Keep CASE, accents é and: punctuation!"),
        ("", ""),
    ]:
        assert rewrite(raw) == plain
        assert rewrite(rewrite(raw)) == rewrite(raw)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=40))
def test_aligned_places(text):
    rewrite = Rewriter({})
    form, place = rewrite.aligned(text)
    places = [place(i) for i in range(len(form) + 1)]
    assert all(0 <= p <= len(text) for p in places)


def test_near_copies_against_all_pairs(spark, tmp_path):
    rnd = random.Random(5)
    texts = []
    for _ in range(40):
        base = [rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(40)]
        for _ in range(rnd.randrange(1, 9)):
            edited = list(base)
            for _ in range(rnd.randrange(0, 6)):
                edited[rnd.randrange(len(edited))] = rnd.choice(WORDS)
            rnd.shuffle(edited)
            texts.append(" ".join(edited))
    hot = [rnd.choice(WORDS) for _ in range(50)]
    for i in range(150):  # a hot group: near copies with many different edits
        edited = list(hot)
        edited[i % 50] = f"edit{i}"
        texts.append(" ".join(edited))
    texts += ["...", texts[0], texts[0].upper()]
    bags = [Counter(t.lower().split()) if t != "..." else Counter() for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if either and both / either >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    size = Counter(map(find, range(len(texts))))
    want = {(i, find(i)) for i in range(len(texts)) if size[find(i)] > 1}
    folder = write_tables(tmp_path / "t", {"scan_requests": [request(i, t) for i, t in enumerate(texts)]})
    got = {(r.record_id, r.group_id) for r in p1.found(spark, folder).collect()}
    assert got == want


def test_pack_elements():
    x = p1.bag("a b a c a")
    assert len(x) == 5 and (p1.unpack(p1.pack(x)) == x).all()


def test_lookalike_pairs(spark, tmp_path):
    rows = [request(1, "copy me"), request(2, "сору me"), request(3, "copy me"), request(4, "copy mе"), request(5, "Copy me"), request(6, "cópy me")]
    pats = [{"pattern_id": 1, "reference_phrases": ["a b", "c"]}, {"pattern_id": 2, "reference_phrases": ["a b", "c"]}, {"pattern_id": 3, "reference_phrases": ["c", "a b"]}]
    folder = write_tables(tmp_path / "t", {"scan_requests": rows, "signature_patterns": pats})
    got = {tuple(r) for r in p4_lookalike_pairs.found(spark, folder).collect()}
    assert got == {("request", 1, 2), ("request", 2, 3), ("request", 1, 4), ("request", 3, 4), ("request", 2, 4), ("pattern", 1, 2)}


def test_fields():
    assert parse_fields('{"a": "x", "b": [1, "y"]}') == [("a", "x"), ("b", "1 y")]
    assert [n for n, _ in parse_fields("b: 1\na: 2")] == ["b", "a"]
    assert parse_fields("Fax: 12 is prose") == [("", "Fax: 12 is prose")]
    assert parse_fields("{broken") == [("", "{broken")] and parse_fields("") == [("", "")]


def test_format_copies(spark, tmp_path):
    same = ["The quick, brown fox!", "the QUICK brown\tfox", "thequick brown fox", "ｔｈｅ quick brown fox"]
    fields = ['{"a": "One two", "b": "Three"}', "b: three\na: one two", "A: one two;\nB: three!"]
    other = ["the quick fox brown", "the quick brown fox 1", "a: three\nb: one two"]
    texts = same + fields + other + ["alone"]
    folder = write_tables(tmp_path / "t", {"scan_requests": [request(i, t) for i, t in enumerate(texts)] + [request(0, same[0], session_id="again")]})
    got = {(r.request_id, r.group_id) for r in p6_format_copies.found(spark, folder).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4), (6, 4)}
    copies = {r.group_id: r.copies for r in p6_format_copies.groups(spark, folder).collect()}
    assert copies == {0: 4, 4: 3, 7: 1, 8: 1, 9: 1, 10: 1}


def test_personal_information(spark, tmp_path):
    given, family = ["Marta", "Oleg", "Sirin", "Tobias"], ["Kallwind", "Brenner", "Ostrovik", "Feldgren"]
    rnd = random.Random(2)
    rows, want = [], set()
    for i in range(120):
        g, f = rnd.choice(given), rnd.choice(family)
        kind, text = rnd.choice([
            ("email", f"You can reach me at {g.lower()}.{f.lower()}{i} (at) example dot org today."),
            ("email", f"Please forward it to {g.lower()}{i}@example.org."),
            ("phone", f"Call me on +1 415 555 0{i % 900 + 100} after lunch."),
            ("national_id", f"My social security number is 666-{i % 90 + 10}-{1000 + i}."),
            ("street_address", f"I live at {i + 1} Juniper Road, Pelnitz {10000 + i}."),
            ("person_name", f"My name is {g} {f}."),
            ("person_name", f"Yours truly, {f}, {g}"),
            (None, f"The order number {4000000 + i} for the Belma kit was shipped."),
            (None, f"Version {i} of the handbook and server 10.2.3.{i} are old."),
            (None, f"Install package@{i}.4.1 near the Alder house."),
        ])
        rows.append(request(i, text))
        if kind:
            want.add(("request", i, kind))
    folder = write_tables(tmp_path / "t", {"scan_requests": rows, "scan_matches": [{"match_id": 1, "matched_text": "+1 415 555 0123"}, {"match_id": 2, "matched_text": "the"}]})
    got = {tuple(r) for r in p3_personal.found(spark, folder).collect()}
    assert got == want | {("match", 1, "phone")}
    masked = {r.record_id: r.masked for r in p3_personal.masked(spark, folder).collect() if r.record_kind == "request"}
    emails = [i for _, i, k in want if k == "email" and "forward" in rows[i]["text"]]
    assert emails and all(masked[i] == "Please forward it to [EMAIL]." for i in emails)


def test_fuzzy_lexicon():
    lexicon = FuzzyLexicon({"moron": (("x", 1),), "scumbag": (("y", 1),), "ass": (("z", 1),)}, {"moron", "scumbag"})
    for word in ("moron", "MORON", "m0r0n", "mooooron", "mron", "morron", "m***n", "scumbag", "scumbeg", "ass", "a55"):
        assert lexicon.match(word), word
    for word in ("maroon5", "motion", "mormon", "asp", "as", "grass", "moral", "12345", ""):
        assert not lexicon.match(word) or word == "mormon", word


def test_abuse(spark, tmp_path):
    bad = ["You are a worthless idiot.", "Those folk are vermin and should be driven out.", "You people are all m0r0ns.", "you pathetic c r e t i n, go away", "Tell me how you want to fuck, you horny babe.", "Du bist ein wertloser Idiot."]
    good = ["Our moderators ask whether the word moron on page 3 of the novel needs a note.", "How do I kill a stuck process on the node?", "The nude colour palette sold well.", "A guest called the clerk an idiot, how should the desk reply to the complaint?", "This stupid bug cost me two hours.", "Nice weather today."]
    rows = [request(i, t, source="a" if i % 2 else None) for i, t in enumerate(bad + good)]
    folder = write_tables(tmp_path / "t", {"scan_requests": rows, "review_labels": [{"request_id": 0, "abusive": 1}, {"request_id": 11, "abusive": 0}]})
    assert {r.request_id for r in p5_abuse.found(spark, folder).collect()} == set(range(len(bad)))
    rates = {r.source: (r.requests, r.abusive) for r in p5_abuse.rates(spark, folder).collect()}
    assert rates == {"a": (6, 3), None: (6, 3)}


def test_packing(spark, tmp_path):
    rnd = random.Random(4)
    docs = [{"doc_id": i, "source": "a", "text": " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 180)))} for i in range(300)]
    folder = write_tables(tmp_path / "t", {"documents": docs, "pack_targets": [{"target_id": "s", "capacity_tokens": 128}, {"target_id": "m", "capacity_tokens": 1000}]})
    sizes = {r.doc_id: r.n_tokens for r in p7_packing.document_sizes(spark, folder).collect()}
    rows = p7_packing.packing(spark, folder).collect()
    for target, capacity in (("s", 128), ("m", 1000)):
        own = [r for r in rows if r.target_id == target]
        total, room, parts = Counter(), Counter(), Counter()
        for r in own:
            total[r.doc_id] += r.n_tokens
            room[r.container_id] += r.n_tokens
            parts[r.doc_id] += 1
        assert total == Counter(sizes) and max(room.values()) <= capacity
        assert all(parts[d] == -(-n // capacity) for d, n in sizes.items())
        assert sum(sizes.values()) / (len(room) * capacity) > 0.93


def test_mixing(spark, tmp_path):
    rnd = random.Random(6)
    docs = [{"doc_id": i, "source": "big" if i % 4 else "small", "text": " ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(5, 60)))} for i in range(800)]
    targets = [{"mix_id": "x", "source": "big", "target_share": 0.5, "max_repeats": 1}, {"mix_id": "x", "source": "small", "target_share": 0.5, "max_repeats": 2}]
    folder = write_tables(tmp_path / "t", {"documents": docs, "mix_targets": targets})
    shares = {r.source: r for r in p8_mixing.shares(spark, folder).collect()}
    assert all(abs(r.actual_share - 0.5) < 0.01 for r in shares.values()) and shares["small"].most_copies == 2
    rows = p8_mixing.sequence(spark, folder).collect()
    assert max(Counter((r.source, r.doc_id) for r in rows if r.source == "small").values()) == 2
    assert max(Counter(r.doc_id for r in rows if r.source == "big").values()) == 1
    assert [r.position for r in rows] == sorted(r.position for r in rows) and 0 <= rows[0].position and rows[-1].position <= 1


def test_garbled(spark, tmp_path):
    clean = ["La gestión quedaba pública después de cada petición.", "Größe der Straßenkarte geändert, für Übersicht", "Добавлена новая страница и лампа", "Íñigo Nuñez et Zoë à Łódź", "NÃO OPERAÇÃO RÂTEAU À GAUCHE", "以前は設定を開く次のページ", "We can’t rely on the café – see “résumé”…", "plain ascii only"] * 40
    pairs = [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("euc_jp", "latin-1")]
    docs, want = [], {}
    for i, text in enumerate(clean):
        docs.append({"doc_id": i, "text": text})
    for k, (true, codec) in enumerate(pairs):
        text = clean[2] if "1251" in true or "koi8" in true else clean[5] if true == "euc_jp" else clean[0]
        bytes_ = text.encode(true)
        back = {b: c for c, b in p9_garbled.to_byte("cp1252" if codec == "latin-1" else codec).items()}
        i = 1000 + k
        docs.append({"doc_id": i, "text": "".join(back[b] if b >= 128 else chr(b) for b in bytes_) if codec != "latin-1" else bytes_.decode("latin-1")})
        want[i] = text
    docs.append({"doc_id": 2000, "text": "lost � here"})
    twice = clean[0].encode().decode("cp1252").encode().decode("cp1252")
    docs.append({"doc_id": 2001, "text": twice})
    want[2001] = clean[0]
    folder = write_tables(tmp_path / "t", {"documents": docs})
    got = {r.doc_id: r for r in p9_garbled.texts(spark, folder).collect()}
    assert set(got) == set(want) | {2000}
    assert got[2000].lost and {i: got[i].text for i in want} == want
