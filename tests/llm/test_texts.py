"""Operators on single texts, against brute force, round trips and libraries."""

import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsweave.llm import bottomk, chat, mpegts, packing, quality, secret_scan, simhash, token_counts, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = list(" \n\t'abst12.,éÉΣİ漢́\x1c\xa0") + [" <|endoftext|>", "don't", "the", "  "]


def some_texts(n=600, seed=1):
    rng = random.Random(seed)
    return ["", " ", "a", "aaaa aaaaa"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_token_counts_equal_the_library():
    texts = some_texts()
    library = Tokenizer.from_file(BYTE)
    assert token_counts.TokenCounter(BYTE).count(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_word_ids_equal_the_library():
    texts = some_texts(seed=2) + ["x" * 500 + " y" * 50]
    flat, n = packing.WordEncoder(WORD).encode(texts, 1)
    library = [e.ids + [1] for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert n.tolist() == list(map(len, library)) and flat.tolist() == sum(library, [])


def test_word_ids_of_control_characters_and_long_words_equal_the_library():
    rng = random.Random(9)
    kinds = list("ab-'.\x00\x00\x01\x1f\x7f\u0085 \n") + ["x" * 31, "y" * 32, "z" * 33, "\x00" * 8, "<|endoftext|>", "é"]
    texts = ["-- --\x00", "!", "!\x00", "!\x00\x00"] + ["".join(rng.choice(kinds) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    library = Tokenizer.from_file(WORD)
    encoder = packing.WordEncoder(WORD)
    for a in range(0, len(texts), 2_000):
        part = texts[a : a + 2_000]
        flat, n = encoder.encode(part)
        ids = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert n.tolist() == list(map(len, ids)) and flat.tolist() == sum(ids, [])


def test_packing_serves_every_id_once_and_pads_nothing():
    rng = np.random.default_rng(5)
    sizes, queue = rng.integers(1, 900, 400), rng.integers(0, 3, 400)
    share = np.bincount(queue, sizes, 3) / sizes.sum()
    pieces = list(packing.serve(sizes, queue, np.zeros(3), share, 256, 32))
    seen = {d: [] for d in range(400)}
    rooms = {}
    for doc, start, length, seq, offset in pieces:
        assert rooms.get(seq, 0) == offset and length > 0
        rooms[seq] = offset + length
        seen[doc].append((start, length))
    for d, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == sizes[d]
    assert all(r == 256 or r & (r - 1) == 0 for r in rooms.values()) and sum(r != 256 for r in rooms.values()) <= 8
    # the first half of the windows holds each source near its share
    half = np.zeros(3)
    for doc, _, length, seq, _ in pieces:
        if seq < len(rooms) // 2:
            half[queue[doc]] += length
    assert np.abs(half / half.sum() - share).max() < 0.02


def brute_spans(text):
    anycase = secret_scan.ASSIGN.replace("(password", "((?i:password", 1).replace("key)", "key))", 1)
    out = [(m.start(), 0, m.end()) for m in re.finditer(anycase, text, re.ASCII) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(secret_scan.ACCESS, text) if len(m[0]) >= 18]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(secret_scan.HEX, text) if len(m[0]) >= 16])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["password", "ToKen", ":", "=", " ", '"', "AKIA", "A1B2", "0123abcd", "api_key", "ſecret", "xyz-_.", "é"]), max_size=20).map("".join))
def test_base_spans_equal_brute_force(text):
    assert secret_scan.base_spans(text) == brute_spans(text)


def test_guess_cost_orders_passwords():
    cost = secret_scan.guess_bits
    assert cost("password") < cost("Password1") < cost("hunter2") < cost("xK9$mQ2vLp8#")
    for weak in ("aaaaaaaaaaaa", "qwertyuiop", "abcabcabcabc", "20240115", "zxcvbnm123"):
        assert cost(weak) < 30
    assert cost("x" * 5000) < 40 and secret_scan.guess_spans("my password is xK9$mQ2vLp8# ok") == [(15, 3, 27)]
    assert secret_scan.redacted("é password=c6d64b9a661f85b709.") == "é [SECRET]"
    assert secret_scan.redacted("nothing here") == "nothing here"


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 5760, 5951, 6143, 6144, 6145, 55303])
def test_transport_stream_round_trip(size):
    text = os.urandom(size)
    payload = mpegts.payload_of(text)
    media = mpegts.write_stream(payload)
    back = mpegts.read_stream(media)
    assert back.payload == payload and payload[:size] == text and payload[size:].strip(b" ") == b"" and len(payload) % 192 == 0 and payload
    assert back.cc_errors == 0 and len(media) % 188 == 0 and back.pid == mpegts.DATA_PID
    assert back.pts == [k * mpegts.UNIT * mpegts.UNITS * mpegts.TICKS for k in range(len(back.pts))]
    assert len(back.random_access) == -(-len(back.pts) // mpegts.GAP)


def test_transport_stream_notices_damage():
    media = mpegts.write_stream(mpegts.payload_of(b"x" * 3000))
    assert mpegts.read_stream(media[: 188 * 5] + media[188 * 6 :]).cc_errors == 1
    with pytest.raises(ValueError):
        mpegts.read_stream(media[:20] + b"\0" + media[21:])
    with pytest.raises(ValueError):
        mpegts.read_stream(media[1:])


def foreign_stream(units, rng, pid=0x77, twice=0.0, tables_in_pieces=False):
    """A stream as another writer would make it: fields of any size in any packet, packets
    without payload, other PIDs between, packets sent twice, units of unbounded length."""
    counters, out = {}, []

    def put(p, data, start, field=None, payload=True):
        n = counters.get(p, 0) if payload else counters.get(p, 0) - 1
        counters[p] = n + 1
        head = bytes([0x47, (0x40 if start else 0) | p >> 8, p & 255, (0x20 if field is not None else 0) | (0x10 if payload else 0) | n & 15])
        packet = head + (b"" if field is None else bytes([len(field)]) + field) + data
        assert len(packet) == 188
        out.append(packet)
        if payload and rng.random() < twice:
            out.append(packet)

    def table(p, body):
        data = b"\x00" + body
        if tables_in_pieces:  # the field leaves room for 9 bytes at first
            put(p, data[:9], True, bytes([0]) + b"\xff" * 173)
            data = data[9:]
            put(p, data.ljust(184, b"\xff"), False)
        else:
            put(p, data.ljust(184, b"\xff"), True)

    table(0, mpegts.section(0, 1, b"\x00\x00\xe0\x10" + b"\x00\x05\xe1\x23"))
    table(0x123, mpegts.section(2, 5, (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x03\x05\x01\x00" + b"\x1b" + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00"))
    for k, unit in enumerate(units):
        stamp = b"\x80\x05" + mpegts.pts_bytes(1000 * k) if k % 2 else b"\x00\x03\xff\xff\xff"
        body = b"\x80" + stamp + unit
        pes = b"\x00\x00\x01\xe0" + (0 if k % 3 == 0 else len(body)).to_bytes(2, "big") + body
        start = True
        while pes:
            room = rng.randint(1, 184)
            take = pes[:room]
            field = None if len(take) == 184 else b"" if len(take) == 183 else bytes([0x40 if start and k % 2 else 0]) + b"\xff" * (182 - len(take))
            put(pid, take, start, field)
            pes, start = pes[room:], False
            if rng.random() < 0.2:
                put(pid, b"", False, b"\x00" + b"\xff" * 182, payload=False)
            if rng.random() < 0.2:
                put(0x1FFF, b"\x00" * 184, False)
    return out


def test_every_missing_packet_is_an_error_and_names_the_unit_that_was_hit():
    payload = mpegts.payload_of(bytes(range(256)) * 75)
    media = mpegts.write_stream(payload)
    grid = [media[k : k + 188] for k in range(0, len(media), 188)]
    units = [payload[k : k + mpegts.UNIT * mpegts.UNITS] for k in range(0, len(payload), mpegts.UNIT * mpegts.UNITS)]
    unit_of, unit = [], -1
    for packet in grid[2:]:
        unit += packet[1] & 0x40 != 0
        unit_of.append(unit)
    for k in range(2, len(grid)):
        cut = b"".join(grid[:k] + grid[k + 1 :])
        hit = unit_of[k - 2]
        back = mpegts.read_stream(cut)
        assert back.damaged == [hit], k
        assert back.payload == b"".join(u for i, u in enumerate(units) if i != hit)
        with pytest.raises(ValueError):
            mpegts.read_stream(cut, strict=True)


def test_scrambled_packets_are_refused():
    media = bytearray(mpegts.write_stream(mpegts.payload_of(b"x" * 3000)))
    media[188 * 4 + 3] |= 0x80
    with pytest.raises(ValueError, match="scrambled"):
        mpegts.read_stream(bytes(media))


def test_transport_stream_of_another_writer():
    rng = random.Random(7)
    for n in range(30):
        units = [rng.randbytes(rng.randint(0, 900)) for _ in range(rng.randint(1, 7))]
        back = mpegts.read_stream(b"".join(foreign_stream(units, rng, twice=0.3 * (n % 2), tables_in_pieces=n % 3 == 0)), strict=True)
        assert back.payload == b"".join(units) and back.cc_errors == 0 and back.stream_type == 0x1B and back.pid == 0x77
        assert back.pts == [1000 * k if k % 2 else None for k in range(len(units))]


def test_transport_stream_reports_gaps_and_missing_tables():
    rng = random.Random(8)
    units = [rng.randbytes(600) for _ in range(4)]
    packets = foreign_stream(units, rng)
    own = [k for k, p in enumerate(packets) if p[1] & 0x1F == 0 and p[2] == 0x77 and p[3] & 0x10]
    begins = [k for k in own if packets[k][1] & 0x40]
    inner = next(k for k in own if begins[1] < k < begins[2])
    cut = b"".join(packets[:inner] + packets[inner + 1 :])
    back = mpegts.read_stream(cut)
    assert back.cc_errors == 1 and back.damaged == [1] and back.payload == units[0] + units[2] + units[3]
    with pytest.raises(ValueError):
        mpegts.read_stream(cut, strict=True)
    for bad in (packets[1:], packets[:1], packets[:1] + packets[2:], packets[:2], []):
        with pytest.raises(ValueError):
            mpegts.read_stream(b"".join(bad), strict=True)
    long_field = packets[inner][:3] + b"\x30\xc8" + packets[inner][5:]
    with pytest.raises(ValueError):
        mpegts.read_stream(b"".join([*packets[:inner], long_field, *packets[inner + 1 :]]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tööl"]), st.lists(st.sampled_from(["[", "<", "/", "\\", "INST]", "</s>", "<s>", "[/ASST]", " ", "x", "TURN ]"]), max_size=8).map("".join)), max_size=5))
def test_chat_round_trip(turns):
    assert chat.parse("<s>" + "".join(chat.render(*t)[0] for t in turns)) == turns


def brute_simhash(text):
    import xxhash

    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text)) if w]
    if not words:
        return 0
    n = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force():
    texts = [t.encode() for t in some_texts(200, 4)]
    assert simhash.fingerprints(texts).tolist() == [brute_simhash(t) for t in texts]


def labels_of(fps, edges):
    index = {int(f): i for i, f in enumerate(fps)}
    label = list(range(len(fps)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        i, j = root(index[int(a)]), root(index[int(b)])
        label[max(i, j)] = min(i, j)
    return [root(i) for i in range(len(fps))]


def families(seed=0, n=12, each=25):
    rng, out = random.Random(seed), set()
    for _ in range(n):
        base = rng.getrandbits(64)
        for _ in range(each):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            out.add(x)
    return np.array(sorted(out), np.uint64)


def all_links(fps, radius=3):
    return [(a, b) for i, a in enumerate(fps.tolist()) for b in fps.tolist()[:i] if (a ^ b).bit_count() <= radius]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_bit_sliced_forest_equals_brute_force(radius):
    fps = families()
    want = labels_of(fps, all_links(fps, radius))
    assert labels_of(fps, zip(*simhash.forest(fps, np.array([0]), radius))) == want
    runs = np.arange(0, len(fps), 40)
    inside = [(a, b) for a, b in all_links(fps, radius) if np.searchsorted(fps, a) // 40 == np.searchsorted(fps, b) // 40]
    assert labels_of(fps, zip(*simhash.forest(fps, runs, radius))) == labels_of(fps, inside)


def test_masks_lose_no_pair():
    masks, rng = simhash.first_masks(), random.Random(3)
    for _ in range(3000):
        differ = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not differ & m for m in masks)


def test_bottom_k_merges_and_estimates():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    a = " ".join(words[:3000]).encode()
    b = " ".join(words[1000:]).encode()
    sketch = bottomk.Sketcher(256)
    x, y = sketch(a), sketch(b)
    assert abs(bottomk.resemblance(x, y, 256) - 0.5) < 0.12 and abs(bottomk.distinct(x, 256) / 2996 - 1) < 0.25
    assert abs(bottomk.containment(x, y, 256) - 2 / 3) < 0.2
    # a sketch of two parts is the merge of their sketches
    parts = [b"p%d q r s t" % i for i in range(500)]
    whole = np.unique(np.concatenate([sketch(p) for p in parts]))[:256]
    merged = sketch(parts[0])
    for p in rng.sample(parts, len(parts)):
        merged = bottomk.merge(merged, sketch(p), 256)
    assert (merged == whole).all() and (bottomk.load(bottomk.dump(merged)) == merged).all()
    assert bottomk.resemblance(sketch(b""), sketch(b" ")) == 1.0 and bottomk.resemblance(sketch(b""), x) == 0.0


def test_toxicity_learns_from_document_labels_and_finds_sentences():
    rng = random.Random(6)
    plain = [f"w{i}" for i in range(300)]

    def text(bad):
        lines = [" ".join(rng.choices(plain, k=8)) + "." for _ in range(rng.randint(1, 12))]
        if bad:
            lines[rng.randrange(len(lines))] += f" you {rng.choice(['vilest', 'vilely', 'grotty'])} thing."
        return "\n".join(lines).encode()

    y = np.array([int(rng.random() < 0.3) for _ in range(1200)])
    texts = [text(v) for v in y]
    scorer = toxicity.Scorer(toxicity.train([toxicity.bag(t) for t in texts[:900]], y[:900]))
    found = np.array([scorer(t)[0] >= 0.5 for t in texts[900:]])
    assert (found == y[900:]).mean() > 0.97
    bad = b"Fine here. You grotty thing! Fine again."
    score, p, ends = scorer(bad)
    start, end = map(int, toxicity.spans(bad, p, ends).split(":"))
    assert score >= 0.5 and b"grotty" in bad[start:end] and b"Fine" not in bad[start:end]


def test_factorisation_machine_identity_and_interactions():
    rng = np.random.default_rng(2)
    model = quality.Model(0.3, rng.normal(size=30), rng.normal(size=(30, 4)), np.zeros((0, 11)))
    index, value = np.array([1, 5, 9, 20]), rng.normal(size=4)
    pairs = sum(model.factors[index[i]] @ model.factors[index[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert np.isclose(quality.evaluate(model, index, value, np.array([0]))[0], 0.3 + model.weights[index] @ value + pairs)
    # a label that only an interaction of two statistics shows
    stats = rng.random((4000, 2))
    y = ((stats[:, 0] > 0.5) ^ (stats[:, 1] > 0.5)).astype(float)
    none = [np.zeros(0, np.int64)] * 4000
    fitted = quality.train(none[:3000], stats[:3000], y[:3000], bits=4, epochs=40, rate=0.05)
    z = quality.evaluate(fitted, *quality.assemble(none[3000:], quality.binned(stats[3000:], fitted.edges, 16)))
    assert ((z > 0) == y[3000:]).mean() > 0.85


