"""What the findings of the third round asked for: runs encoded as one text, common words counted whole, buckets met whole."""

import numpy as np
import pyarrow as pa
import xxhash

from lectern.llm import near, pitman_yor, records
from lectern.llm.common import batched


def test_runs_go_to_the_tokenizer_as_one_text(spark):
    encoder = records.ChunkEncoder(records.session_tokenizer(spark, "word_bpe_49k.json"))
    whole, given = encoder.tokenizer, []

    class Counted:
        def encode_batch_fast(self, texts, **more):
            given.append(len(texts))
            return whole.encode_batch_fast(texts, **more)

    encoder.tokenizer = Counted()
    plain = ["It's one, don't 'S 12 İ é .é x́", "", "< <| <<|endoftext|>> <|startof text|> 漢字 ...!"]
    marked = ["a <|startoftext|>x c", "<|startoftext| oftext|> b"]
    for texts in (plain, marked):
        ids, at = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert given == [1, 1, 6]  # a run that holds the mark sends all six one by one


def test_own_contexts_are_the_commonest_words_however_spread(spark, monkeypatch):
    """``even`` is below the first count's share in every batch, yet as a whole it is the second of all words."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    monkeypatch.setattr(pitman_yor, "OWN", 2)
    monkeypatch.setattr(pitman_yor, "RARE", 10)
    texts = [" ".join(["most"] * 60 + ["even"] * 8 + [f"w{i}"] * 32) for i in range(12)]
    hashes = sorted(np.array([xxhash.xxh64_intdigest(w, 5) for w in ("most", "even")], np.uint64).view(np.int64).tolist())
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert pitman_yor.commonest(docs, "text").tolist() == hashes
    monkeypatch.setattr(pitman_yor, "OWN", 1)
    assert pitman_yor.commonest(docs, "text").tolist() == [np.array([xxhash.xxh64_intdigest("most", 5)], np.uint64).view(np.int64)[0]]
    assert pitman_yor.commonest(docs.limit(0), "text").tolist() == []
    batched(spark)


def test_a_bucket_of_many_loses_no_link(spark, monkeypatch):
    """All texts share 80 shingles and nothing more: four of them (similarity 0.82) are copies, which their one first partner in a bucket may well not be."""
    monkeypatch.setattr(near, "NEXT", 1)
    common = [f"c{i}" for i in range(84)]
    texts = [common + [f"t{i}x{j}" for j in range(9 if i % 75 == 10 else 30)] for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    assert dict(near.near_copies(docs).collect()) == {i: 10 if i % 75 == 10 else i for i in range(300)}
