"""Alignment of two tokenizers: against a plain version with the files' own libraries."""

import hashlib
import random
from collections import Counter

import corpus as c
import numpy as np
import pytest

from aetherlog import schemas
from aetherlog.llm import alignment as A
from aetherlog.sources import readers

ODD = ["<|endoftext|> and <s> </s> <unk>", "a ▁ b", "tab\tand\n\nlines  ", "   ", " ", "zero\x00byte", "日本語のテキスト、空白なし。" * 40, "👩‍👩‍👧 é é <0x0A>",
       "it's we'll THEY'RE 12345 !!! 　x", "\n", "x" * 3000, "ha " * 2000]


@pytest.fixture(scope="module")
def both():
    with open(A.BYTE_BPE, "rb") as f, open(A.PIECE_BPE, "rb") as g:
        return f.read(), g.read()


def libraries(files):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_buffer(files[0]), sentencepiece.SentencePieceProcessor(model_proto=files[1])
    a.encode_special_tokens = True
    return a, b


def plain(rows, files):
    a, b = libraries(files)
    alphabet = A._byte_alphabet()
    links, out = {}, {}
    for key, text in rows:
        out[key] = (0, 0, 0, 0, "")
        links[key] = []
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        said_a = [bytes(alphabet[ch] for ch in a.id_to_token(i)) for i in ids_a]
        said_b = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in ids_b)]
        if not text or not b"".join(said_a) == b"".join(said_b) == (" " + text).encode():
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in said_a]).tolist(), np.cumsum([len(x) for x in said_b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups, i, j = [], 0, 0
        for e in common:
            k, m = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            i, j = k, m
        j = 0
        for i, e in enumerate(ends_a):
            start = ends_a[i - 1] if i else 0
            while ends_b[j] <= start:
                j += 1
            m = j
            while m < len(ends_b) and (ends_b[m - 1] if m else 0) < e:
                links[key].append((ids_a[i], ids_b[m]))
                m += 1
        out[key] = (len(ids_a), len(ids_b), len(groups), len(links[key]), hashlib.sha256(";".join(groups).encode()).hexdigest())
    count = Counter(p for x in links.values() for p in x)
    most = {}
    for (_, q), n in count.items():
        most[q] = max(most.get(q, 0), n)
    return {k: (*v[:4], sum(count[p] == most[p[1]] for p in links[k]), sum(count[p] for p in links[k]), v[4]) for k, v in out.items()}


def got(df, key="transcript_id"):
    return {r[key]: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_token_links_equal_plain_version(spark, both, tmp_path):
    rows = [(r[0], r[1]) for r in c.rows(6, 25)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)]
    df = spark.createDataFrame([(i, "tower", None, None, None, None, None, t, 0.5) for i, t in rows], schemas.TRANSCRIPTS)
    df.repartition(3).write.parquet(str(tmp_path / "heard"))
    want = plain(rows, both)
    found = got(A.token_links(readers.transcripts(spark, str(tmp_path / "heard"))))
    assert found == want
    assert sum(v[0] == 0 for v in found.values()) >= 3


def test_windows_do_not_change_a_text(both, monkeypatch):
    t = A.load(*both)
    digits = A._digits(max(t.sizes))
    texts = [r[1] for r in c.rows(9, 12)] + ODD

    def links(window):
        monkeypatch.setattr(A, "WINDOW", window)
        return {o.row: (o.exact, o.counts, o.digest.hexdigest(), [x.tolist() for x in A._counted(o.pairs)]) if o.exact else False
                for o in A.align_texts(texts, t, digits)}
    assert all("".join(A.windows(x)) == x for x in texts if x)
    whole = links(1 << 20)
    monkeypatch.setattr(A, "BLOCK", 20)
    monkeypatch.setattr(A, "PIECE", 300)
    assert links(30) == whole == links(1)
    assert len(A.windows("word " * 100)) > 30


def test_encoders_equal_their_libraries(both):
    t = A.load(*both)
    a, b = libraries(both)
    rng = random.Random(3)
    texts = ODD + ["".join(chr(rng.choice([rng.randrange(1, 0x500), rng.randrange(0x2000, 0x3100), rng.randrange(0x1F300, 0x1F700)])) for _ in range(80)) for _ in range(300)]
    assert t.encode_a([" " + x for x in texts]) == [e.ids for e in a.encode_batch([" " + x for x in texts], add_special_tokens=False)]
    assert t.encode_b(texts) == b.encode(texts)


def test_galloping_equals_binary_search():
    rng = np.random.default_rng(5)
    for n, m in ((1, 1), (3, 50), (40, 7), (0, 4), (200, 3000)):
        held, wanted = np.unique(rng.integers(0, 5000, m)), np.unique(rng.integers(0, 5200, n))
        first = rng.integers(0, 1 + np.searchsorted(held, wanted))
        assert (A.gallop(wanted, held, first, np.full(len(wanted), len(held))) == np.searchsorted(held, wanted)).all()


def test_token_links_odd_rows(spark):
    rows = [(None, "wind light and variable"), (None, "wind light and variable"), (1, None), (2, ""), (1, "gale warning"), (1, "gale warning")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "transcript_id BIGINT, text STRING, block STRING, pair STRING")
    out = A.token_links(df).collect()
    assert len(out) == 6 and sum(r.n_links for r in out if r.transcript_id is None) == 2 * max(r.n_links for r in out)
    assert all(r.count_sum >= 2 * r.n_links for r in out) and all((r.groups_sha256 == "") == (r.n_a == 0) for r in out)
    assert A.token_links(df.limit(0)).count() == 0
    as_text = df.withColumn("transcript_id", df.transcript_id.cast("string"))
    assert A.token_links(as_text).schema["transcript_id"].dataType.simpleString() == "string"
