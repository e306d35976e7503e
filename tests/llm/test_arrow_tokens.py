import numpy as np
import public_tokenizers
import pyarrow as pa
from test_packing import whole

from chaffline.llm import arrow_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def expected(documents, end_id=2):
    encode, start, rows = whole(PATH), 0, []
    for doc, text in sorted(documents, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*encode(text), end_id]
        rows.append((doc, start, len(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return rows


def test_round_trip_of_odd_documents(odd_documents, odd_rows, monkeypatch):
    manifest = arrow_tokens.write_tokens(odd_documents, PATH, width=64)
    rows = sorted(arrow_tokens.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in rows] == expected(odd_rows)


def test_random_access(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    manifest = arrow_tokens.write_tokens(documents, PATH, width=128).orderBy("part", "file").collect()
    texts = expected([(r.doc_id, r.text) for r in documents.collect()])
    stream = np.concatenate([np.frombuffer(ids, "<u4") for *_, ids in texts])
    assert sum(m.n_tokens for m in manifest) == len(stream)
    for m in manifest:
        file = arrow_tokens.TokenFile(m.path)
        own = stream[m.base : m.base + m.n_tokens]
        rows = -(-m.n_tokens // 128)
        for row in {0, rows // 2, rows - 1}:
            ids, mask = file.sequence(row)
            real = own[row * 128 : (row + 1) * 128]
            assert mask.sum() == len(real) and (ids[mask] == real).all() and not ids[~mask].any()
        assert file.file.schema.field("ids").type == pa.list_(pa.uint16(), 128)
        assert file.sequence(0)[0].base is not None  # a view, not a copy
        file.close()


def test_empty_table(no_documents):
    manifest = arrow_tokens.write_tokens(no_documents, PATH)
    assert manifest.collect() == [] and arrow_tokens.read_tokens(manifest).collect() == []


def test_several_files_in_a_partition(odd_documents, odd_rows, monkeypatch):
    import chaffline.llm.arrow_tokens as module

    # The limit is read in the tasks' own processes, so the writer is driven directly here.
    monkeypatch.setattr(module, "BATCH_ROWS", 2)
    ids = np.arange(1000, dtype=np.uint32)
    from tempfile import mkdtemp

    path = f"{mkdtemp()}/x.arrow"
    writer = module.TokenWriter(path, 8, pa.uint32())
    for a, b in ((0, 300), (300, 301), (301, 1000)):
        writer.add(pa.array([a]), ids[a:b], np.array([b - a]))
    writer.close()
    file = module.TokenFile(path)
    assert file.stretch(0, 1000).tolist() == list(range(1000)) and file.stretch(299, 3).tolist() == [299, 300, 301]
    assert file.documents["start"].to_pylist() == [0, 300, 301]
