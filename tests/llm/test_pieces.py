import hashlib
import io
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from tidemill.llm.pieces import CharacterMap, Encoder, encode_pieces, op3_sentencepiece

from .conftest import SF, TEXTS

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_query(spark, docs):
    sp, want = library(), {}
    for r in docs.collect():
        ids = sp.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op3_sentencepiece(spark, SF).collect()} == want


def test_odd_rows_and_spans(spark, odd_docs, no_docs):
    sp = library()
    rows = encode_pieces(odd_docs, MODEL, ("ids", "begins", "ends", "decoded")).collect()
    texts = odd_docs.select("text").collect()
    assert len(rows) == len(texts)
    for r, (text,) in zip(rows, texts):
        assert r.ids == sp.encode(text or "", add_eos=True)
        assert r.decoded == sp.decode(r.ids)
        data = (text or "").encode()
        assert r.begins[:1] in ([], [0]) and r.begins[1:] == r.ends[:-1] and (not r.ends or r.ends[-1] == len(data))
        for i, a, b in zip(r.ids, r.begins, r.ends):
            if not sp.is_byte(i):
                assert data[a:b].decode().replace(" ", "▁") in (sp.id_to_piece(i), sp.id_to_piece(i)[1:])
    assert encode_pieces(no_docs, MODEL).collect() == []


def compiled(rules: dict[bytes, bytes]) -> bytes:
    """A small character map: a trie with every node's children at a free base."""
    values, pool = {}, b""
    for k, v in rules.items():
        values[k], pool = len(pool), pool + v + b"\0"
    units, used = {0: 0}, {0}

    def place(prefix: bytes, node: int) -> None:
        labels = sorted({k[len(prefix)] for k in rules if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in rules
        base = next(b for b in range(1, 1 << 16) if all((b ^ c) not in used for c in [*labels, *([0] if leaf else [])]) and (b ^ node) < 1 << 21)
        units[node] |= ((node ^ base) << 10) | (leaf << 8)
        used.update(base ^ c for c in labels)
        if leaf:
            used.add(base)
            units[base] = values[prefix] | 1 << 31
        for c in labels:
            units[base ^ c] = c
        for c in labels:
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    array = np.zeros(max(units) + 1, np.uint32)
    for k, v in units.items():
        array[k] = v
    return struct.pack("<I", array.nbytes) + array.tobytes() + pool


def test_character_map_and_alignment():
    rules = {"ﬁ".encode(): b"fi", "①".encode(): b"1", b"ab": b"X", b"abc": b"", "é".encode(): "é".encode()}
    encoder = Encoder(MODEL)
    encoder.map = CharacterMap(compiled(rules))
    assert encoder.map.longest(b"abcd", 0) == (3, b"")
    assert encoder.map.longest(b"abd", 0) == (2, b"X") and encoder.map.longest(b"a", 0) is None
    normal, at = encoder.normalise("ﬁ ab abc é")
    assert normal.decode() == "▁fi▁X▁▁é"
    assert at.tolist() == [0, 0, 0, 0, 0, 3, 3, 3, 4, 6, 6, 6, 10, 10, 10, 11, 11, 11, 13]
    assert len(at) == len(normal) + 1


def test_a_batch_is_looked_up_as_columns():
    sp, encoder, asked = library(), Encoder(MODEL, most=8), []
    encode = encoder._encode
    encoder._encode = lambda chunks: (asked.append(chunks.to_pylist()), encode(chunks))[1]
    for texts in (["a b a b", None, "b a\nb  c", ""] * 50, TEXTS, TEXTS[::-1], ["a b"], []):
        ids, ends, where = encoder(pa.array(texts, pa.string()))
        want = [sp.encode(t or "") for t in texts]
        assert ids.tolist() == [i for x in want for i in x] and ends.tolist() == [0, *np.cumsum([len(x) for x in want], dtype=int).tolist()]
        assert [where[b - 1, 1] for a, b in zip(ends, ends[1:]) if b > a] == [len(t.encode()) for t in texts if t]
    assert sorted(asked[0]) == ["\n", "  c", " a", " b", "b"]
    assert all(len(x) == len(set(x)) for x in asked)
    part = pa.array(TEXTS, pa.string())[3:6]
    assert encoder(part, False)[0].tolist() == [i for t in TEXTS[3:6] for i in sp.encode(t)]


def test_a_model_without_byte_pieces(spark, odd_docs, tmp_path):
    model, path = io.BytesIO(), str(tmp_path / "small.model")
    texts = ["the same text of six words here", "a b ab the tea text"] * 50
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(texts), model_writer=model, vocab_size=40, model_type="bpe", normalization_rule_name="identity", remove_extra_whitespaces=False, minloglevel=2)
    with open(path, "wb") as f:
        f.write(model.getvalue())
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = encode_pieces(odd_docs, path, ("ids", "begins", "ends")).collect()
    assert any(sp.unk_id() in r.ids for r in rows)
    for r, (text,) in zip(rows, odd_docs.select("text").collect()):
        assert r.ids == sp.encode(text or "", add_eos=True)
        data = (text or "").encode()
        assert r.begins[:1] in ([], [0]) and r.begins[1:] == r.ends[:-1] and (not r.ends or r.ends[-1] == len(data))
        for i, a, b in zip(r.ids, r.begins, r.ends):
            assert i == sp.unk_id() or data[a:b].decode().replace(" ", "▁") in (sp.id_to_piece(i), sp.id_to_piece(i)[1:])
