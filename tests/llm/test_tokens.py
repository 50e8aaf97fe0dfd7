"""Token files and packing against the tokenizer itself; the pipeline stage by stage."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing, token_files, tokens
from quillspark.llm.shared import new_path
from quillspark.llm.tokens import encoder, vocabulary_path


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(vocabulary_path())
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")


def test_chunked_encoding_is_the_tokenizers_own(ids):
    r = random.Random(1)
    parts = ["a", "B", "é", "ß", " ", "  ", "\n", "\n\n", "\t", " ", "!", "'s", "'", "9", "12", "中", "文", "🎉", "<|endoftext|>", "_", "-", ".", "…", "́", "\r", " ", "don't", "x", " the", "word.", "word,\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(1500)]
    e = encoder(vocabulary_path())
    for t, raw in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(raw, dtype=e.dtype).tolist() == ids(t).tolist(), repr(t)


def test_other_tokenizers_are_encoded_whole():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    own, e = Tokenizer.from_file(path), encoder(path)
    texts = ["Some  words, and <|endoftext|> more.", "", "über  allem\n\nx"]
    assert not e.cuts
    assert [np.frombuffer(x, dtype=e.dtype).tolist() for x in e.encode(texts)] == [[*own.encode(t, add_special_tokens=False).ids, 0] for t in texts]


def test_the_encoder_forgets_what_came_last(ids):
    e = encoder(vocabulary_path())
    texts = [" ".join(f"w{i}x{k}" for k in range(50)) for i in range(20)]
    before = e.encode(texts)
    e.known = dict(list(e.known.items())[:10])
    assert e.encode(texts) == before == [ids(t).astype(e.dtype).tobytes() for t in texts]


def test_token_files_round_trip(spark, odd, ids):
    rows = sorted((i, t) for i, t in odd if t is not None) + [(0, None)]
    rows = sorted(rows, key=lambda x: (x[0], x[1] or ""))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    manifest = token_files.write_token_files(d, new_path(spark, "files"), seq_len=64, partitions=3)
    found = sorted((x.start, x.doc_id, x.n_tokens, x.ids_crc32) for x in token_files.read_back(manifest).collect())
    at, want = 0, []
    for i, t in rows:
        own = ids(t)
        want.append((at, i, len(own), zlib.crc32(own)))
        at += len(own)
    assert found == want
    # random access to whole sequences, and masks that are false on padding alone
    for file, group in {x.file: x for x in manifest.collect()}.items():
        del group
        f = token_files.TokenFile(file)
        total = sum(x.n_tokens for x in manifest.collect() if x.file == file)
        n = -(-total // 64)
        masks = [f.sequence(k)[1] for k in range(n)]
        assert all(len(m) == 64 for m in masks) and sum(m.sum() for m in masks) == total
        assert f.ids(0, min(total, 64)).tolist() == f.sequence(0)[0][: min(total, 64)].tolist()


def check_pieces(rows, found, ids, window):
    want = Counter(i for i, _ in rows)
    tokens = {}
    for i, t in rows:
        tokens.setdefault(i, []).append(ids(t))
    seqs = {}
    for p in found:
        assert any(p.doc_tokens == len(x) and zlib.crc32(x[p.start : p.start + p.length]) == p.ids_crc32 for x in tokens[p.doc_id])
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sum(p.length for p in found) == sum(len(x) for v in tokens.values() for x in v)
    assert Counter(p.doc_id for p in found if p.start == 0) == want
    for s, pieces in seqs.items():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end and length > 0
            end += length
        assert end == window or s == max(seqs)


def test_packing(spark, odd, ids):
    d = spark.createDataFrame(odd, "doc_id long, text string").repartition(4)
    for window in (16, 1024):
        check_pieces(odd, packing.packed(d, window).collect(), ids, window)


def test_odd_tables(spark, docs, no_docs, odd):
    assert packing.packed(docs).where("start = 0").count() == len(odd) + 1
    assert packing.packed(no_docs).count() == 0
    assert token_files.read_back(token_files.write_token_files(docs, new_path(spark, "odd"))).count() == len(odd) + 1
    assert token_files.read_back(token_files.write_token_files(no_docs, new_path(spark, "none"))).count() == 0


def test_pipeline(spark, odd, ids, tmp_path):
    import corpus_pipeline as P
    from test_dedup import brute_components
    from test_text import brute_hits, labelled

    rows, _, labels = labelled(spark)
    rows = [*rows, *((10_000 + i, t) for i, t in odd), *((20_000 + i, t) for i, t in rows[1:200:3])]
    items = [(1, " ".join(rows[7][1].split()[3:15])), (2, "nothing of that kind is anywhere in here at all")]
    # clashing names, and a row without an id
    spark.createDataFrame([(i, t, "en", "s", 0, 7, "clash", -2, "d") for i, t in [*rows, (None, "no id at all")]], "doc_id long, text string, lang string, source string, n_chars long, row long, class string, n long, digest string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    steps, columns = {}, docs.columns
    for name, stage in P.STAGES:
        named = lambda i: i is not None or name == "packing"  # noqa: B023, E731  the row without an id is packed like others
        before = [(x.doc_id, x.text) for x in docs.collect() if named(x.doc_id)]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = (before, [x for x in docs.collect() if named(x.doc_id)])
        assert name == "packing" or docs.columns == columns
    kept = {i for i, t in rows if i < 10_000 and i % 5}
    assert kept <= {x.doc_id for x in steps["quality_classifier"][1]}
    before, after = steps["exact_dedup"]
    best = {}
    for i, t in before:
        best[t or ""] = max(best.get(t or "", i), i)
    assert {x.doc_id for x in after} == set(best.values())
    before, after = steps["minhash_near_dedup"]
    unique = [(i, t) for i, t in before]
    assert {x.doc_id for x in after} == set(brute_components(unique, 5, 80).values())
    before, after = steps["benchmark_decontamination"]
    assert {x.doc_id for x in after} == {i for i, t in before if not brute_hits(t, items, 8)[1]}
    before, after = steps["packing"]
    check_pieces(before, after, ids, 1024)
    first = P.run(spark, str(tmp_path))
    whole = P.run(spark, str(tmp_path)).collect()
    assert first.count() == len(whole)  # a result that is held can still be read after another run
    assert Counter((x.doc_id, x.doc_tokens) for x in whole if x.start == 0) == Counter((x.doc_id, x.doc_tokens) for x in after if x.start == 0)


def test_pipeline_of_nothing(spark, no_docs, tmp_path):
    import corpus_pipeline as P

    no_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_encoder_remembers_half_a_million_chunks():
    enc = tokens.Encoder(tokens.vocabulary_path())
    texts = ["some words, and\nmore", "some words and others"]
    want = enc.encode(texts)
    enc.known.update((f"\0{i}", b"") for i in range(500_000))
    assert enc.encode(texts) == want and len(enc.known) > 500_000
    enc.known.update((f"\0{i}", b"") for i in range(700_000))
    assert enc.encode(texts) == want and len(enc.known) <= tokens.KEPT
