"""The registered queries themselves, over whole tables, against brute force by the public libraries."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import __spark_entry__
from plasmaspark.llm import registry
from tests.llm.test_operators import _sets, _slow_fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()}


@pytest.fixture(scope="module")
def rows(spark):
    return lambda name: __spark_entry__.queries()[name](spark, SF).collect()


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(rows, docs):
    got = {r.doc_id: r for r in rows("op1_toxicity")}
    toxic = dict(duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{SF}/labels.parquet' GROUP BY doc_id").fetchall())
    assert set(got) == set(docs) and all(0 <= r.p_toxic <= 1 and r.toxic == (r.p_toxic >= 0.5) for r in got.values())
    assert sum(got[i].toxic for i, t in toxic.items() if not t and i in got) <= 0.05 * len(toxic)


def test_op3(rows, docs):
    ids = sorted(docs)
    codes = [_slow_fingerprint(docs[i], 4) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if (codes[a] ^ codes[b]).bit_count() <= 4]
    want = {i: (f"{c:016x}", ids[r]) for i, c, r in zip(ids, codes, _sets(len(ids), links), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows("op3_simhash")} == want


def test_op4(rows, docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = {i: library.encode_ordinary(t) for i, t in docs.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows("op4_byte_bpe")} == {i: (len(x), sha(",".join(map(str, x))), sha(docs[i])) for i, x in ids.items()}


def test_op5(rows, docs):
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    got = {r.doc_id: r for r in rows("op5_langid")}
    held = {i for i in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert set(got) == set(docs) and {i for i, r in got.items() if r.held_out} == held
    assert all(0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[i])) for i, r in got.items())
    known = [i for i in held if langs[i] and got[i].lang_pred != "und"]
    assert sum(got[i].lang_pred == langs[i] for i in known) >= 0.95 * len(known)


def _spans(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def test_op6(rows, docs):
    def base(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = [int(c) for c in m.group() if c.isdigit()]
            if 16 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0:
                out.append(("card", *m.span()))
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]

    for r in rows("op6_pii"):
        want = base(docs[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in want) for x in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == sha(_spans(want)) and r.spans.startswith(_spans(want))


def test_op7(rows, docs):
    ids = sorted(docs, reverse=True)
    got = {r.doc_id: r for r in rows("op7_merkle")}
    for i, x in enumerate(ids):
        text, following = docs[x], docs[ids[(i + 1) % len(ids)]]
        k = len(text) // 3
        assert got[x].n_chars == len(text) and got[x].edited_sha256 == sha(text[: len(text) - k] + following[:k])
        assert 0 <= got[x].near_next <= 1 and 0 <= got[x].near_edited <= 1
    long = [x for x in ids if len(docs[x]) > 500]
    assert np.mean([got[x].near_edited for x in long]) > 0.4 > 0.2 > np.mean([got[x].near_next for x in long])


def test_op8(rows, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in docs.items()}
    seen, filled = {}, {}
    for r in sorted(rows("op8_packing"), key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        filled[r.sequence_id] = r.offset + r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {i: len(x) for i, x in ids.items()} == {i: sum(n for _, n in p) for i, p in seen.items()}
    assert all(a + n == b for p in seen.values() for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:], strict=False)) and max(filled.values()) <= 4096


def test_op9(rows):
    turns: dict = {-1: [("user", registry.CONFLICT), ("assistant", registry.CONFLICT)]}
    for c, _, r, t in duckdb.sql(f"SELECT conv_id, turn, role, coalesce(text, '') FROM '{SF}/conversations.parquet' ORDER BY ALL").fetchall():
        turns.setdefault(c, []).append((r, t))
    got = {r.conv_id: r for r in rows("op9_chat")}
    assert set(got) == set(turns)
    for c, own in turns.items():
        under = "".join(t for r, t in own if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(under), sha(under))
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{t}\n" for r, t in own))


def test_op10(rows, docs):
    def base(t):
        out = [("assign", *m.span()) for m in re.finditer(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m.group(1)) >= 8]
        out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
        out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
        return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))

    for r in rows("op10_secrets"):
        want = base(docs[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in want) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == sha(_spans(want)) and set(_spans(want).split(",")) <= set(r.spans.split(",")) | {""}
