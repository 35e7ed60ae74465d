"""Operators that look at one text at a time, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panweave.llm import bpe, language, licenses, media, quality, toxicity
from panweave.llm.word_tokens import WordTokens

ODD = [None, "", " ", "\n\n", "a", "ab " * 40, "é ü x", "x" * 5000, "naïve\x1cname\x85end", "🙂 漢字 ́e", "a\r\nb\vc\fd\te"]


def plain_features(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    n = len(words)
    doubled = sum(x in lines[:i] for i, x in enumerate(lines))
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(inside), n < 50 or 100 * len(inside) > 50 * n


@given(st.text(alphabet="ab \n#|\x1c\x85é\t\r", max_size=120))
@settings(max_examples=300, deadline=None)
def test_quality_features(text):
    assert quality.features(text)[:6] == plain_features(text)


@pytest.mark.parametrize("text", ODD)
def test_quality_features_of_odd_texts(text):
    assert quality.features(text)[:6] == plain_features(text)


def test_label_model():
    good, junk = 3**9 - 1, 0
    posts = quality.fit({good: 900, junk: 80, good - 2: 20})
    assert posts[good] > 0.9 and posts[junk] < 0.1
    assert quality.fit({}) == {}
    mostly_junk = quality.fit({good: 100, junk: 850, good - 2: 50})
    assert mostly_junk[good] > 0.9 and mostly_junk[junk] < 0.01
    neutral = sum(3**i for i in range(9))
    assert quality.fit({neutral: 5})[neutral] >= 0.5  # no bad vote, no rejection


def plain_license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@given(st.lists(st.sampled_from(["MIT", "license", "Apache", "general", "public", "é", "x"]), max_size=30), st.sampled_from([" ", "-", "\n", ". "]))
@settings(max_examples=200, deadline=None)
def test_license_places(words, sep):
    text = sep.join(words)
    plain, starts, labels = plain_license_words(text), [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(plain)):
            if plain[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    got = licenses.scan(text)
    assert got[:5] == (len(plain), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)))


def test_license_expressions():
    assert licenses.parse("A OR B AND C WITH d") == ["A", "B", "C", "d", "WITH", "AND", "OR"]
    assert licenses.evaluate("MIT OR GPL-3.0-only") == ({"mit", "gpl"}, 1.0)
    assert licenses.evaluate("(MIT OR Apache-2.0) AND GPL-2.0-or-later")[1] == 0.4
    for bad in ("MIT OR", "AND MIT", "(MIT", "MIT)", "MIT MIT", "MIT (GPL-2.0)", ""):
        with pytest.raises(ValueError):
            licenses.evaluate(bad)
    assert "unparsed" in licenses.scan("SPDX-License-Identifier: MIT OR")[5]
    label = lambda text: licenses.scan(text)[5::2]
    assert label("SPDX License Identifier: MIT") == label("// spdx-license-identifier : MIT -->\nGPL") == label("x\nSPDX-License-Identifier: MIT see the file") == ("mit", 1)
    assert label("/* SPDX-License-Identifier: (MIT or Apache-2.0) and BSD-3-Clause. */") == ("apache,bsd,mit", 1)
    assert label("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: GPL-2.0-only WITH x-exception") == ("gpl,mit", 2)
    assert label("the SPDX license identifier is missing") == ("", 0) and label("SPDX-License-Identifier:") == ("unparsed", 1)
    assert licenses.scan("SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND MIT")[6] == 1.0 and licenses.scan("SPDX-License-Identifier: MIT AND GPL-2.0-only")[6] == 0.4
    long = "SPDX-License-Identifier: MIT\nmit license " * 20_000
    assert licenses.scan(long)[1:4] == (20_000, 4, 6 * 20_000 - 2) and licenses.scan(long)[7] == 20_000
    assert licenses.scan(None) == (0, 0, None, None, "", "", 0.0, 0)


@given(st.binary(min_size=1, max_size=40000))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(payload):
    stored = media.mux(payload)
    got = media.demux(stored)
    assert got.payload == payload and got.continuity_errors == 0 and len(stored) % 188 == 0
    units = -(-len(payload) // media.UNIT)
    assert got.timestamps == [i * media.PTS_STEP for i in range(units)] and got.random_access == list(range(0, units, media.RAP_EVERY))


def test_media_faults_and_digest():
    payload = random.Random(1).randbytes(media.UNIT * 20 + 7)
    stored = media.mux(payload)
    lost = stored[: 188 * 10] + stored[188 * 11 :]
    assert media.demux(lost).continuity_errors == 1
    for bad in (b"", stored[:-1], b"x" + stored[1:], stored[188 * 2 :], stored[:12] + b"\xee" + stored[13:]):
        with pytest.raises(media.MediaError):
            media.demux(bad)
    for text in ODD:
        n, padded = media.payload_of(text)
        raw = (text or "").encode()
        assert n == len(raw) and len(padded) % 192 == 0 and len(padded) > 0 and padded.rstrip(b" ") == raw.rstrip(b" ")
        row = media.digest(n, media.mux(padded))
        assert row[:4] == (n, len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))


def packets(stored):
    return [stored[i : i + 188] for i in range(0, len(stored), 188)]


def test_media_that_others_write():
    """What the format allows, put together by hand."""
    payload = random.Random(2).randbytes(media.UNIT * 2 + 100)
    all_ = packets(media.mux(payload))
    head, own = all_[:2], all_[2:]
    want = media.demux(b"".join(all_))
    assert want.payload == payload
    twice = [p for i, p in enumerate(own) for p in ([p, p] if i % 5 == 0 else [p])]  # packets sent twice
    idle = lambda counter: media.packet(media.STREAM_PID, False, counter, b"")[:3] + bytes([0x20 | counter, 183, 0]) + b"\xff" * 182
    filled = [x for p in own for x in (p, idle(p[3] & 15))]  # packets with an adaptation field alone
    null = bytes([0x47, 0x1F, 0xFF, 0x10]) + b"\xff" * 184
    for kind in (twice, filled, [x for p in own for x in (null, p)]):
        assert media.demux(b"".join([*head, *kind])) == want
    starts = [i for i, p in enumerate(own) if p[1] & 0x40]
    open_ = [p if i not in starts else p[: (at := p.index(b"\x00\x00\x01")) + 4] + b"\x00\x00" + p[at + 6 :] for i, p in enumerate(own)]
    assert media.demux(b"".join([*head, *open_])) == want  # elementary packets of unstated length
    jump = [bytes([*p[:3], p[3] & 0xF0 | (p[3] + 5 * (i >= starts[1])) & 15, *p[4:]]) for i, p in enumerate(own)]
    assert media.demux(b"".join([*head, *jump])).continuity_errors == 1
    bad = [*own[:3], bytes([*own[3][:1], own[3][1] | 0x80, *own[3][2:]]), *own[4:]]
    assert media.demux(b"".join([*head, *bad])).continuity_errors == 2  # a faulty packet, and the gap


def test_media_tables_of_many_packets():
    """A program map that spans packets, with other streams and descriptors before ours, and a network entry before the program."""
    payload = random.Random(3).randbytes(500)
    own = packets(media.mux(payload))[2:]
    entry = lambda kind, pid, info: bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info
    body = (0xE000 | media.STREAM_PID).to_bytes(2, "big") + (0xF000 | 7).to_bytes(2, "big") + b"abcdefg"
    body += b"".join(entry(0x1B, 0x200 + i, b"d" * 9) for i in range(25)) + entry(media.PRIVATE_DATA, media.STREAM_PID, b"xyz")
    section = b"\x00" + media.section(2, 1, body)
    program = media.section(0, 1, bytes([0, 0, 0xE0, 0x10]) + media.PROGRAM.to_bytes(2, "big") + (0xE000 | media.PMT_PID).to_bytes(2, "big"))
    tables = [media.packet(0, True, 0, (b"\x00" + program).ljust(184, b"\xff"))]
    tables += [media.packet(media.PMT_PID, i == 0, i, section[184 * i : 184 * (i + 1)].ljust(184, b"\xff")) for i in range(-(-len(section) // 184))]
    assert len(tables) > 2 and media.demux(b"".join([*tables, *own])).payload == payload


BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    own = bpe.encoder(BPE, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_bpe_equals_the_library(pair):
    own, library = pair
    rng = random.Random(7)
    alphabets = ["abcdefghij", "aeiou nt", "\n \t a.", "ñéü漢字🙂ab", "     a", "==--##'s", "0123 ", "  a\x1c\x85b", "a"]
    for n in (0, 1, 2, 5, 9, 17, 40, 120, 400, 3000):
        for letters in alphabets:
            text = "".join(rng.choices(letters, k=n))
            ids = library.encode_ordinary(text)
            assert own.encode(text) == ids
            assert own.decode(ids) == text.encode()
            assert own.digest(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    texts = [None, "", " ", "a", " a", "a ", "a  b", "\n a\n", *("".join(rng.choices("ab \n.é", k=k)) for k in range(200))]
    assert own.digests(texts) == [own.digest(x) for x in texts]
    assert own.digests([]) == [] and own.digests([None]) == [own.digest("")]
    assert own.digest(None) == own.digest("") and own.digest(None)[0] == 0


@pytest.mark.parametrize("text", ["title\n" + "—" * 100, "x " + "。" * 80, "…" * 333, "█" * 1000, "あ" * 2000, "\u0301" * 300, "=" * 5000, "ab" * 5000, "ÿ" * 999, "\x00" * 400])
def test_bpe_of_long_runs(pair, text):
    own, library = pair
    assert own.encode(text) == library.encode_ordinary(text) and own.decode(own.encode(text)) == text.encode()


def test_merges_with_and_without_a_heap(pair, monkeypatch):
    own, _ = pair
    monkeypatch.setattr(bpe, "SHORT", 0)
    rng = random.Random(8)
    for n in range(60):
        data = bytes(rng.choices(rng.choice([b"aeiountsr ", bytes(range(256)), b"=- "]), k=n))
        assert own.merge(data) == own.leaf(data)


def test_unsound_tokens_are_never_stable():
    """A token that merges don't reach: its pairs aren't trusted, and the encoding is still that of plain merges."""
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abcd": 258, b"cd": 259}
    own = bpe.Encoder(ranks, r".+")
    assert not own.is_sound(258) or own.leaf(b"abcd") == (258,)
    rng = random.Random(1)
    for n in range(80):
        data = bytes(rng.choices(b"abcd", k=n))
        if data not in ranks:
            assert own.encode_piece(data) == own.leaf(data)


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_units_end_where_pieces_end(pair, text):
    own, _ = pair
    pieces = [p for u in bpe.units(text, own.pattern) for p in own.pattern.findall(u)]
    assert pieces == own.pattern.findall(text)


WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_word_tokens_equal_the_tokenizer():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(WORDS), WordTokens(WORDS)
    plain.encode_special_tokens = True
    texts = [x for x in ODD if x] + [
        "J̌ J̌. Å, Ab. a.b, c., d,. 3.14, a\x01b. \x01 x", "don't!! it's. (x) [a]. €5. 5€. é!! é—.. x—,", "<|endoftext|> a'll ΑΣ ΟΔΟΣ.", "İstanbul ǅ ﬁ ß ẞ",
        "one two. Two, one; (three) x$$$ y*** $$$ . , .. a|b |",
    ]
    rng = random.Random(3)
    texts += ["".join(rng.choices("abCÉé'.,!$ \n0_-—́", k=60)) for _ in range(300)]
    want = [np.array(plain.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert own.ids(texts) == want
    assert own.ids(texts) == want  # from the table
    assert own.ids([None, ""]) == [b"", b""]


def lexicon(words=None, stems=None):
    return toxicity.Lexicon(words or {"clown": 2.0}, stems or {})


def test_grammar():
    score = lambda text: toxicity.clause_score(text.split(), lexicon())
    plain, aimed, after, negated, said = score("what a clown"), score("you are a clown"), score("clown that you are"), score("not a clown"), score("he wrote clown")
    assert negated[0] < said[0] < plain[0] < aimed[0] == after[0]
    meant, aimed, backwards, alone = score("i will kill you"), score("kill you"), score("you i will kill"), score("kill")
    assert alone[1] < backwards[1] < aimed[1] < meant[1] and score("i will not kill you")[1] < alone[1]
    assert score("he said i will kill you")[1] < alone[1]
    assert score("an ordinary clause") == (0.0, 0.0)
    assert toxicity.text_features(None, lexicon()) == (0.0, 0.0, 0.0, 0.0)
    assert toxicity.text_features("A clown. Fine words. CLOWN!", lexicon())[2] > 0
    model = toxicity.Model({}, {}, toxicity.PRIOR)
    low, high = model.scores(["They will burn wood.", "I will kill you!"])
    assert low < 0.5 < high


@given(st.lists(st.sampled_from("ITYNRWO"), max_size=30))
@settings(max_examples=300, deadline=None)
def test_composed_transducers_equal_one_after_the_other(symbols):
    whole = toxicity.run(toxicity.GRAMMAR, symbols)
    written, insults, threats = symbols, [0.0] * len(symbols), [0.0] * len(symbols)
    for part in toxicity.PARTS:
        written, i, t = toxicity.run(part, written)
        insults, threats = [a + b for a, b in zip(insults, i, strict=True)], [a + b for a, b in zip(threats, t, strict=True)]
    assert whole == (written, pytest.approx(insults), pytest.approx(threats))


@given(st.lists(st.text("abc", min_size=1, max_size=6), max_size=12), st.lists(st.text("abc", min_size=3, max_size=4), max_size=4), st.lists(st.text("abc", min_size=1, max_size=6), max_size=4))
@settings(max_examples=200, deadline=None)
def test_trie_equals_prefix_search(read, stems, words):
    stems, words = {s: 1.0 + i for i, s in enumerate(stems)}, {w: 9.0 + i for i, w in enumerate(words)}
    own = lexicon(words or {"zz": 1.0}, stems)
    for word in read:
        fits = [s for s in stems if word.startswith(s)]
        want = ("I", words[word]) if word in words else ("I", stems[max(fits, key=len)]) if fits else ("O", 0.0)
        assert own.read(word) == want
    assert own.any_hot(set(read)) == any(own.read(w)[0] == "I" for w in read)


def test_choosing_terms():
    """Against the test's formula, written out."""
    import math

    counts = [("bad ", 0, 30), ("badly ", 1, 12), ("rare ", 0, 3), ("fine ", 300, 30), ("zor", 2, 60), ("zorg", 1, 20), ("zork", 1, 20), ("bad", 1, 42), ("badl", 1, 12)]
    words, stems = toxicity.choose_terms(counts, np.array([900, 100]))
    odds = lambda n1, n0: min(math.log((n1 + 0.5) / 101 * 901 / (n0 + 0.5)), toxicity.MOST_ODDS)
    assert words == pytest.approx({"bad": odds(30, 0), "badly": odds(12, 1)})
    assert stems == pytest.approx({"zor": odds(60, 2), "zorg": odds(20, 1), "zork": odds(20, 1)})
    assert toxicity.choose_terms(counts, np.array([900, 0])) == ({}, {})


def test_visible_text():
    page = "a<nav x>menu<b>y</b></nav >b<!-- <p>hidden --><script>1 < 2</script>c<div class='ad big'>buy</div>d &amp; e<NAV>open <p>f<br/>1 < 2"
    assert language.visible(page).split() == ["a", "b", "c", "d", "&", "e", "open", "f", "1", "<", "2"]
    assert language.visible(None) == ""
    for part in ("<nav ", "<nav>", "<!--", "<", "<div class=ad>", "</nav>", "<html lang"):
        import time

        begin = time.process_time()
        language.visible(part * 200_000)
        language.declared(part * 200_000)
        assert time.process_time() - begin < 8


def test_evidence_of_pages():
    assert language.declared("<HTML dir=ltr LANG='FR-ca'>") == "fr" and language.declared('<meta http-equiv="content-language" content="de">') == "de"
    assert language.declared("<p lang=es>") is None and language.declared(None) is None
    languages = ["de", "en", "es", "fr", "pt"]
    place = lambda url: language.address(url, languages)
    assert place("https://www.a.co.uk/x") == ("www.a.co.uk", "a.co.uk", "en") and place("https://b.co.uk")[1] == "b.co.uk"
    assert place("https://shop.c.at/fr/1") == ("shop.c.at", "c.at", "fr") and place("https://c.at")[2] == "de" and place("http://d.com.br/")[1:] == ("d.com.br", "pt")
    assert place("https://es.e.org/") == ("es.e.org", "e.org", "es") and place("https://e.org/")[2] is None and place("x")[0] == "" and place(None) == ("", "", None)
