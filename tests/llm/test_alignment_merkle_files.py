"""Token alignment, Merkle manifest and token files against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import alignment as A
from textlab.llm import catalog
from textlab.llm import merkle as M
from textlab.llm import token_files as T
from textlab.llm.tokens import default_path
from textlab.session import scratch_dir

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- alignment ---------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def vocabularies():
    return A.ByteLevel(A._path(A.BYTE_BPE)), A.Pieces(A._path(A.PIECE_BPE))


def hostile_texts():
    rnd = random.Random(7)
    parts = ["the", " ", "  ", "   ", "\n", "\t", "é", "日本", "\U0001f600", "<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", "=" * 30,
             "aaaa", "Ünï", "ß", ".", "'s", "123", "\x00", "ſ", " a", "b ", "word", "­", "́"]
    out = ["".join(rnd.choices(parts, k=rnd.randint(1, 40))) for _ in range(200)]
    return out + ["▁ab", " lead", "trail ", "x" * 5000, "= " * 3000, "ab cd " * 2000, "é" * 999, "…" * 300 + "=" * 700, " ", "\n"]


def test_ids_are_the_files_own(vocabularies):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(A._path(A.BYTE_BPE))
    tok.encode_special_tokens = True
    texts = hostile_texts()
    got = vocabularies[0].encode(texts)
    for k, e in enumerate(tok.encode_batch([" " + t for t in texts], add_special_tokens=False)):
        assert got.ids[got.starts[k]:got.starts[k + 1]].tolist() == e.ids, texts[k]


def plain_groups(text, va, vb):
    """[(A ids, B ids)] of a text, token by token."""
    if not text:
        return []
    a, b = va.tok.encode_ordinary(" " + text), vb.tok.encode(text)
    bytes_a, bytes_b = [va.strings[i].as_py() for i in a], [vb.strings[i].as_py() for i in b]
    raw = (" " + text).encode()
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return []
    ends_b = set(np.cumsum([len(x) for x in bytes_b]).tolist())
    cuts = [int(e) for e in np.cumsum([len(x) for x in bytes_a]) if int(e) in ends_b]
    out, i, j, end_a, end_b = [], 0, 0, 0, 0
    for cut in cuts:
        own = ([], [])
        while end_a < cut:
            own[0].append(a[i])
            end_a += len(bytes_a[i])
            i += 1
        while end_b < cut:
            own[1].append(b[j])
            end_b += len(bytes_b[j])
            j += 1
        out.append(own)
    assert i == len(a) and j == len(b)
    return out


def plain_alignment(rows, va, vb):
    groups = [plain_groups(t, va, vb) for _, t in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for own in links for p in own)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = Counter()
    for (doc, _), g, own in zip(rows, groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out[doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(own.values()),
            sum(n for p, n in own.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in own.items()),
            sha(text) if g else ""] += 1
    return out


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_hostile_texts(make, vocabularies):
    rows = [(k, t) for k, t in enumerate(hostile_texts())]
    docs = make("doc_id long, text string", rows).repartition(3)
    got = Counter(tuple(r[c] for c in ALIGNED) for r in A.score(docs).collect())
    assert got == plain_alignment(rows, *vocabularies)
    assert sum(r[3] > 1 for r in got) > 100


def test_lanes_change_nothing(vocabularies, monkeypatch):
    texts = hostile_texts()
    one = A.aligned(texts, *vocabularies)
    for size in (1, 7, 100, 10**9):
        monkeypatch.setattr(A, "LANE_BYTES", size)
        other = A.aligned(texts, *vocabularies)
        assert all((getattr(one, c) == getattr(other, c)).all() for c in ("doc", "from_a", "n_a", "from_b", "n_b"))
    monkeypatch.setattr(A, "LARGE_GROUP", 0)  # by distinct ids: the same links
    for k in range(len(texts)):
        x = A.aligned(texts[k:k + 1], *vocabularies)
        if len(x.doc):
            _, a, b, n = x.links()
            sums = Counter()
            for p, q, m in zip(a.tolist(), b.tolist(), n.tolist()):
                sums[p, q] += m
            assert sums == Counter((p, q) for g in plain_groups(texts[k], *vocabularies) for p in g[0] for q in g[1])


def test_alignment_of_odd_rows(odd, none, vocabularies):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert Counter(tuple(r[c] for c in ALIGNED) for r in A.score(odd).collect()) == plain_alignment(rows, *vocabularies)
    assert A.score(none).count() == 0


def test_alignment_of_a_table(spark, vocabularies):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = Counter(tuple(r[c] for c in ALIGNED) for r in catalog.op11_alignment(spark, SF).collect())
    assert got == plain_alignment(rows, *vocabularies)


# --- Merkle manifest ---------------------------------------------------------------------------------

def plain_root(nodes):
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[k:k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0]


def plain_path(nodes, at):
    out = []
    while len(nodes) > 1:
        run = nodes[at // 16 * 16:at // 16 * 16 + 16]
        out.append(("".join(run[:at % 16]), "".join(run[at % 16 + 1:])))
        nodes = [sha("".join(nodes[k:k + 16])) for k in range(0, len(nodes), 16)]
        at //= 16
    return out


def plain_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    def leaf(doc, source, lang, n, text):
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc, source, lang, n, text)))

    def lower(text):
        return text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)

    trees = defaultdict(list)
    for doc, source, lang, n, text in rows:
        h = leaf(doc, source, lang, n, text)
        odd = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        trees[source].append((doc is not None, doc or 0, h, leaf(doc, source, lang, n, lower(text)) if odd else h, doc))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    roots = [plain_root([x[2] for x in sorted(trees[s], key=lambda x: x[:4])]) for s in order]
    root, out = plain_root(roots), Counter()
    for k, s in enumerate(order):
        own = sorted(trees[s], key=lambda x: x[:4])
        hashes = [x[2] for x in own]
        for at, x in enumerate(own):
            path = plain_path(hashes, at) + plain_path(roots, k)
            h = x[3]
            for left, right in path:
                h = sha(left + h + right)
            out[x[4], x[2], roots[k], root, sha("".join(a + b for a, b in path)), h, h == root] += 1
    return out


MERKLE = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, path string, root string, tree string, at long, n long"


def merkle_rows(sizes):
    rnd = random.Random(3)
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            doc += 1
            rows.append((doc * 7919 % 100003, source, rnd.choice(["en", None]), rnd.choice([5, None]), rnd.choice(["Ab", "é ß", "", None, "low"])))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 17, "b": 1, None: 16, "": 2, "é": 257}, {f"s{k:03}": 1 + k % 3 for k in range(40)},
                                   {"hot": 4096 + 300, "b": 4096, "c": 4097, "d": 33}])
def test_manifest(make, sizes):
    rows = merkle_rows(sizes)
    docs = make(SCHEMA, [(*r, "x", "y", "z", 1, 2) for r in rows]).repartition(5)
    got = Counter(tuple(r[c] for c in MERKLE) for r in M.manifest(docs).collect())
    want = plain_manifest(rows)
    assert got == want
    assert {r[6] for r in got} == {False, True} or len(rows) < 20


def test_manifest_of_odd_rows(odd, none):
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in odd.collect()]
    rows += [(None, None, None, None, None)] * 20 + [(7, "s", None, None, "same"), (7, "s", None, None, "Same")]
    extra = odd.limit(0).select("doc_id", "source", "lang", "n_chars", "text").unionByName(
        odd.sparkSession.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    assert Counter(tuple(r[c] for c in MERKLE) for r in M.manifest(extra).collect()) == plain_manifest(rows)
    assert M.manifest(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 4095, 4096])
def test_sweeps_of_a_block(n):
    leaves = [sha(str(k)) for k in range(n)]
    runs = M.forward(leaves, True)
    assert M.top_of(leaves, runs) == plain_root(leaves)
    found = dict(M.backward(leaves, runs, [{"left": "L", "right": "R"}]))
    assert sorted(found) == list(range(n))
    for k in {0, n // 2, n - 1}:
        path = plain_path(leaves, k) + [("L", "R")]
        assert M.proof(found[k]) == sha("".join(a + b for a, b in path))
        assert M.fold(leaves[k], found[k]) == sha("L" + plain_root(leaves) + "R")
    # a block below others has all its levels
    assert max(M.forward(leaves, False))[0] == M.LEVELS


# --- token files -------------------------------------------------------------------------------------

@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 5000, 70000])
@pytest.mark.parametrize("high", [1, 2, 50000, 2**32])
def test_chunk_round_trip(n, high):
    r = np.random.default_rng(n)
    ids = r.integers(0, high, n, dtype=np.uint64).astype(np.uint32)
    if high == 50000:
        ids = np.where(r.random(n) < 0.985, ids % 300, ids).astype(np.uint32)  # outliers become exceptions
    raw = ids.astype("<u4").tobytes()
    cut = n // 3 * 4
    chunk = T.Chunk(memoryview(T.chunk_of([3, None, -5], [raw[:cut], b"", raw[cut:]]) + b"\nrest"))
    assert chunk.doc_ids == [3, None, -5] and chunk.counts.tolist() == [n // 3, 0, n - n // 3] and chunk.n_ids == n
    assert (chunk.ids_at(0, n) == ids).all()
    for a in (0, n // 2, max(0, n - 3)):
        assert (chunk.ids_at(a, min(n, a + 1500)) == ids[a:a + 1500]).all()


def test_outliers_do_not_widen_a_block():
    ids = np.zeros(1024, np.uint32)
    ids[::100] = 40000
    assert len(T.blocks_of(ids)[0]) == 8 + 4 * 11  # no bits but the exceptions
    with pytest.raises(ValueError):
        T.Chunk(memoryview(b"x" * 64))
    with pytest.raises(ValueError):
        T.Chunk(memoryview(T.chunk_of([1], [ids.tobytes()])[:-1]))


def plain_files(rows):
    """Per row (doc_id, n_tokens, crc), and the starts by doc_id for ids that stand once."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(default_path())
    out, each = Counter(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, T.END_ID]
        out[doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        each.append((doc, len(ids)))
    starts, at = {}, 0
    for doc, n in each:
        starts.setdefault(doc, at)
        at += n
    return out, starts, at


def test_token_files_of_odd_rows(odd, none, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want, starts, total = plain_files(rows)
    for ranges in (None, 1, 3):
        out = scratch_dir(spark, "files")
        T.write(odd, out, ranges=ranges)
        got = T.read_digest(spark, out).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
        spans = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
        assert spans[0][0] == 0 and spans[-1][1] == total and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        first = {}
        for r in sorted(got, key=lambda r: r["start"]):
            first.setdefault(r["doc_id"], r["start"])
        assert first == starts
        whole = T.read(spark, out).collect()
        assert Counter((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in whole) == Counter(
            (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got)
    out = scratch_dir(spark, "files")
    T.write(none, out)
    assert T.read_digest(spark, out).count() == 0 and T.read(spark, out).count() == 0


def test_token_files_of_a_table(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, starts, total = plain_files([(r["doc_id"], r["text"]) for r in docs.collect()])
    monkeypatch.setattr(T, "FILE_CHUNKS", 1)
    got = catalog.op13_token_files(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert {r["doc_id"]: r["start"] for r in got} == starts


def test_files_roll(spark, monkeypatch):
    """Several files of one range keep their order."""
    monkeypatch.setattr(T, "FILE_CHUNKS", 1)
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 150_000).alias("text"))
    out = scratch_dir(spark, "files")
    T.write(docs, out, ranges=2)
    assert spark.read.format("binaryFile").load(out).count() > 4
    got = sorted(T.read_digest(spark, out).collect(), key=lambda r: r["doc_id"])
    assert [r["start"] for r in got] == [150_001 * k for k in range(30)]
