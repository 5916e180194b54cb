"""The store of embeddings, retries, the chain of providers and the local provider."""

import glob
import os
import sys
import urllib.error

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from lodestone import errors
from lodestone.operators import embedding
from lodestone.operators.embed_store import EmbeddingStore, embed_stored, key_of
from lodestone.plans import code_search

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file
TEXTS = "id long, content string"


class Logged:
    """Lengths of texts as vectors; each text sent is a file in ``folder``; fails for good on ``bad``."""

    def __init__(self, folder, bad=None, model="lengths"):
        self.folder, self.bad, self.model_id = str(folder), bad, model

    def get_embeddings(self, texts, task):
        if self.bad in texts:
            raise RuntimeError("killed")
        for t in texts:
            with open(os.path.join(self.folder, f"{hash(t) & 0xFFFFFFFF}-{os.getpid()}-{os.urandom(4).hex()}"), "w") as f:
                f.write(t)
        return [[float(len(t)), 1.0] for t in texts]

    def sent(self):
        return sorted(open(p).read() for p in glob.glob(f"{self.folder}/*"))


def corpus(spark, n=200):
    return spark.createDataFrame([(i, f"text {i % (n // 2)}") for i in range(n)] + [(n, None), (n + 1, "")], TEXTS)


def test_equal_texts_are_sent_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    provider, df = Logged(log), corpus(spark)
    rows = embed_stored(df, provider, str(tmp_path / "store"), buckets=4).collect()
    assert len(rows) == 202 and all(r.vec == [float(len(r.content or "")), 1.0] for r in rows)
    assert provider.sent() == sorted({f"text {i}" for i in range(100)} | {""})
    store = EmbeddingStore(spark, str(tmp_path / "store"), 4)
    assert store.fill(df, provider) == 0 and len(provider.sent()) == 101
    assert store.fill(spark.createDataFrame([(1, "text 1"), (2, "new")], TEXTS), provider) == 1
    assert store.fill(df, Logged(log, model="other")) == 101  # another model has keys of its own
    assert store.fill(df.limit(0), provider) == 0


def test_no_text_is_sent_twice_after_a_killed_run(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    df, store = corpus(spark), EmbeddingStore(spark, str(tmp_path / "store"), 4)
    with pytest.raises(Exception, match="killed"):
        store.fill(df, Logged(log, bad="text 7"), batch=1, per_file=1)
    before = Logged(log).sent()
    stored = store.vectors().count()
    assert 0 < len(before) < 101 and stored == len(before)  # with a file for each text nothing that was sent is lost
    assert store.missing(df, "lengths").count() == 101 - stored
    assert store.fill(df, Logged(log), batch=8) == 101 - stored
    assert Logged(log).sent() == sorted({f"text {i}" for i in range(100)} | {""})


def test_an_attempt_skips_what_a_lost_one_stored(spark, tmp_path, monkeypatch):
    log = tmp_path / "log"
    log.mkdir()
    df, store = corpus(spark), EmbeddingStore(spark, str(tmp_path / "store"), 4)
    store.fill(df.filter("id < 50"), Logged(log))
    asked = df.select(key_of(F.col("content"), "lengths").alias("key"), F.coalesce("content", F.lit("")).alias("text")).dropDuplicates(["key"])
    monkeypatch.setattr(store, "missing", lambda *_: asked)  # as the plan of a run that began before
    assert store.fill(df, Logged(log)) == 51 and len(Logged(log).sent()) == 101


def test_two_files_with_one_key_give_one_row(spark, tmp_path):
    df, store = corpus(spark, 20), EmbeddingStore(spark, str(tmp_path / "store"), 1)
    (tmp_path / "log").mkdir()
    store.fill(df, Logged(tmp_path / "log"))
    (written,) = glob.glob(str(tmp_path / "store" / "bucket=0" / "*.parquet"))
    with open(written, "rb") as f:
        data = f.read()
    for name in ("again.parquet", ".half"):  # a second attempt's file, and one that was not finished
        with open(os.path.join(os.path.dirname(written), name), "wb") as f:
            f.write(data if name[0] != "." else data[:50])
    assert store.vectors().count() == 11 and store.attach(df, "lengths").count() == 22


class Failing:
    model_id = "m"

    def __init__(self, *errors):
        self.errors, self.calls = list(errors), 0

    def get_embeddings(self, texts, task):
        self.calls += 1
        if self.errors:
            raise self.errors.pop(0)
        return [[1.0]] * len(texts)


def http(code, headers=None):
    return urllib.error.HTTPError("http://x", code, "said no", headers, None)


def test_retries_back_off(monkeypatch):
    waits = []
    monkeypatch.setattr(embedding.time, "sleep", waits.append)
    provider = Failing(http(503), TimeoutError(), urllib.error.URLError("refused"), http(429, {"Retry-After": "7"}))
    assert embedding.Retrying(provider).get_embeddings(["a"]) == [[1.0]] and provider.calls == 5
    assert 0.25 <= waits[0] <= 0.5 and 0.5 <= waits[1] <= 1 and 1 <= waits[2] <= 2 and waits[3] == 7
    for lasting in (http(401), ValueError("2 texts sent, 1 vectors received")):
        provider = Failing(lasting)
        with pytest.raises(type(lasting)):
            embedding.Retrying(provider).get_embeddings(["a"])
        assert provider.calls == 1
    provider = Failing(*[http(500)] * 9)
    with pytest.raises(urllib.error.HTTPError):
        embedding.Retrying(provider, tries=3).get_embeddings(["a"])
    assert provider.calls == 3


@pytest.fixture
def model(tmp_path):
    folder = tmp_path / "model"
    folder.mkdir()
    tokenizer = Tokenizer(models.WordLevel({"red": 0, "blue": 1, "?": 2}, unk_token="?"))
    tokenizer.pre_tokenizer = pre_tokenizers.Whitespace()
    tokenizer.save(str(folder / "tokenizer.json"))
    np.save(folder / "embeddings.npy", np.array([[1, 0, 0], [0, 2, 0], [0, 0, 3]], np.float32))
    return str(folder)


def test_local_provider(spark, model):
    provider = embedding.load_provider("local", model=model)
    got = np.array(provider.get_embeddings(["red", "red blue", "green", ""]))
    assert np.allclose(got, [[1, 0, 0], [1 / 5**0.5, 2 / 5**0.5, 0], [0, 0, 1], [0, 0, 0]], atol=1e-6)
    rows = embedding.embed(spark.createDataFrame([("blue",)], "content string"), provider).collect()
    assert np.allclose(rows[0].vec, [0, 1, 0])


def test_the_first_that_answers_is_taken(model):
    embedding.register_provider("broken", lambda **_: Failing(OSError("down")))
    embedding.register_provider("works", lambda **_: Failing())
    embedding.register_provider("refused", lambda **_: Failing(), probe=lambda _: (_ for _ in ()).throw(ValueError("no licence")))
    assert embedding.first_provider(["broken", "refused", "works", "local"], model=model).model_id == "m"
    assert embedding.first_provider(["local", "works"], model=model).model_id == model
    assert embedding.first_provider(["local", "works"], model="/none").model_id == "m"
    with pytest.raises(errors.NoProvider, match="down.*no licence"):
        embedding.first_provider(["broken", "refused"])
    with pytest.raises(ValueError, match="known"):
        embedding.first_provider(["nobody", "works"])


def test_an_index_is_asked_in_its_own_model(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.txt").write_text("some words\n")
    provider, store = Logged(tmp_path / "log"), str(tmp_path / "store")
    for _ in range(2):
        assert code_search.build(spark, str(tmp_path / "src"), store, provider, buckets=2).first().num_chunks == 1
    assert len(provider.sent()) == 1  # the second run had nothing to send
    with pytest.raises(errors.ModelMismatch):
        code_search.search(spark, store, "words", Logged(tmp_path / "log", model="other"))
