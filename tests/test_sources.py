"""Files, code chunks, embeddings, the command line and streams."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle

from lodestone import cli, errors
from lodestone.operators import chunking, embedding, results
from lodestone.plans import code_search
from lodestone.plans.index import VectorIndex
from lodestone.sources import code_files, tables
from lodestone.streaming.stream_search import search_stream


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


class Counter:
    """Embeds a text as its counts of letters."""

    model_id = "letters"

    def get_embeddings(self, texts, task):
        return [[float(t.lower().count(c)) + 0.01 for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]


def test_npy_npz_parquet(spark, tmp_path):
    m = np.random.default_rng(0).normal(size=(100, 8)).astype(np.float32)
    np.save(tmp_path / "m.npy", m)
    np.save(tmp_path / "f.npy", np.asfortranarray(m))
    np.savez(tmp_path / "m.npz", embeddings=m, other=m[:1])
    pq.write_table(pa.table({"id": range(100), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), 8)}), tmp_path / "m.parquet")
    for name, key in (("m.npy", None), ("f.npy", None), ("m.npz", "embeddings"), ("m.parquet", "embedding")):
        rows = tables.from_file(spark, str(tmp_path / name), key).orderBy("row_id").collect()
        assert [r.row_id for r in rows] == list(range(100)) and np.array_equal(np.array([r.vec for r in rows], np.float32), m)
    ids, _ = results.to_numpy(VectorIndex.from_file(spark, str(tmp_path / "m.npz"), "embeddings", enable_cache=False).search(m[:3], 1))
    assert ids.ravel().tolist() == [0, 1, 2]
    parts = spark.read.format("npy").option("rows_per_partition", 30).load(str(tmp_path / "m.npy"))
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 100
    only = tables.from_file(spark, str(tmp_path / "m.parquet"), "embedding")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<embedding" in only  # nothing else is read


def test_file_errors(spark, tmp_path):
    np.save(tmp_path / "d.npy", np.eye(3))
    np.savez(tmp_path / "m.npz", a=np.eye(3, dtype=np.float32))
    (tmp_path / "bad.npy").write_bytes(b"no array")
    pq.write_table(pa.table({"v": [[1.0]], "s": ["x"]}), tmp_path / "d.parquet")
    cases = [("x.csv", None, errors.UnsupportedExtension), ("m.npz", None, errors.MissingKey), ("d.parquet", None, errors.MissingKey), ("d.parquet", "s", errors.UnsupportedColumnType), ("d.parquet", "v", errors.UnsupportedColumnType), ("d.parquet", "none", errors.UnsupportedColumnType)]
    for name, key, error in cases:
        with pytest.raises(error):
            tables.from_file(spark, str(tmp_path / name), key)
    for name, key in (("d.npy", None), ("m.npz", "none"), ("bad.npy", None), ("none.npy", None)):
        with pytest.raises(Exception, match="float32|no array|cannot read"):
            tables.from_file(spark, str(tmp_path / name), key).count()


@pytest.fixture
def tree(tmp_path):
    files = {
        "auth.py": "def login(user):\n    return user\n",
        "README.md": "# title\nwords here\n",
        "src/utils.py": "import os\n\nclass Tool:\n    pass\n",
        ".gitignore": "# comment\n*.log\n\nbuild/\n",
        "debug.log": "x",
        "build/output.js": "function f() {}\n",
        ".hidden/secret.py": "x = 1\n",
        "node_modules/a.js": "x\n",
        "blank.txt": " \n\n",
        "src/__init__.py": "",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "image.png").write_bytes(b"\x89PNG\x00\x00")
    (tmp_path / "data.xyz").write_bytes(b"ab\x00cd")
    (tmp_path / "latin.txt").write_bytes(b"caf\xe9 word\n")
    return tmp_path


def test_discovery(spark, tree):
    found = {r.rel_path: r.content for r in code_files.discover(spark, str(tree)).collect()}
    assert set(found) == {"auth.py", "README.md", "src/utils.py", "src/__init__.py", "blank.txt", "latin.txt"}
    assert found["auth.py"].startswith("def login") and "word" in found["latin.txt"]


def chunks(spark, name, text, **options):
    df = chunking.chunk_files(spark.createDataFrame([(name, text)], "file_path string, content string"), **options)
    return df.orderBy("start_line").collect()


def test_small_and_blank_files(spark):
    (c,) = chunks(spark, "a.txt", "one\ntwo\n")
    assert (c.start_line, c.end_line, c.content, c.preview) == (1, 3, "one\ntwo\n", "one two")
    assert chunks(spark, "a.txt", " \n ") == [] and chunks(spark, "a.txt", "") == []


def test_definitions_stay_whole(spark):
    source = "import os\n\n" + "\n".join(f"def f{i}():\n    return {i}\n" for i in range(40))
    got = chunks(spark, "a.py", source, max_chars=150)
    assert len(got) > 5 and got[0].content.startswith("import os")
    lines = source.split("\n")
    for c in got:
        assert lines[c.start_line - 1] == c.content.split("\n")[0] and lines[c.end_line - 1] == c.content.split("\n")[-1]
        assert c.content.count("def ") == c.content.count("return")
    assert sum(c.content.count("def ") for c in got) == 40


@pytest.mark.parametrize(("name", "text"), [("l.rs", "pub fn a() {\n1\n}\n\nstruct B {\n2\n}\n"), ("a.js", "export function a() {\n1\n}\nclass B {\n2\n}\n"), ("a.ts", "interface A {\n1\n}\nenum B {\n2\n}\n")])
def test_definitions_by_pattern(spark, name, text):
    assert [c.start_line for c in chunks(spark, name, text, max_chars=20)] == [1, 5 if name == "l.rs" else 4]


def test_windows_overlap_and_cover(spark):
    text = "\n".join(f"line {i} " + "x" * 20 for i in range(200))
    got = chunks(spark, "bad.py", "def (:\n" + text, max_chars=500)
    assert got[0].start_line == 1 and got[-1].end_line == 201
    for a, b in zip(got, got[1:], strict=False):
        assert b.start_line == a.end_line - chunking.OVERLAP_LINES + 1
    (whole,) = chunks(spark, "a.txt", "y" * 5000)
    assert whole.end_line == 1 and len(whole.content) == 5000


def test_batches_and_progress(spark):
    seen = []
    out = embedding.embed_local(["a", "b", "c"], Counter(), batch=2, on_progress=lambda done, total: seen.append((done, total)))
    assert len(out) == 3 and seen == [(2, 3), (3, 3)]
    df = embedding.embed(spark.createDataFrame([("abc",), (None,)], "content string"), Counter(), batch=1)
    assert [len(r.vec) for r in df.collect()] == [26, 26]
    with pytest.raises(ValueError, match="no provider"):
        embedding.load_provider("none")


def test_http_provider():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            data = [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(asked["input"])]
            body = json.dumps({"data": data[::-1]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    provider = embedding.load_provider("http", url=f"http://127.0.0.1:{server.server_port}/", model="m")
    assert provider.get_embeddings(["a", "bbb"]) == [[1.0], [3.0]]
    assert embedding.embed_query("xx", provider) == [2.0]
    server.shutdown()


def test_code_search_end_to_end(spark, tree, capsys):
    embedding.register_provider("letters", lambda **_: Counter())
    store = str(tree / cli.STORE)
    assert cli.main(["info", "-d", str(tree / "src")]) == 1
    assert cli.main(["embed", "-d", str(tree), "--provider", "letters"]) == 0
    chunks_df, meta = code_search.load(spark, store)
    assert meta.first().asDict() == {"model": "letters", "dims": 26, "num_chunks": 4} and "content" not in chunks_df.columns
    top = code_search.search(spark, store, "class Tool: pass import os", Counter(), 2).collect()
    assert top[0].file.endswith("src/utils.py") and top[0].lines == "1-5" and top[0]["rank"] == 1
    assert cli.main(["search", "login", "-d", str(tree), "--provider", "letters", "-k", "1"]) == 0
    assert cli.main(["info", "-d", str(tree)]) == 0
    assert "vectors: 4" in capsys.readouterr().out


def test_stream(spark, tmp_path):
    m = np.eye(8, dtype=np.float32)
    index = VectorIndex.from_local(spark, m, enable_cache=False)
    source = str(tmp_path / "in")
    spark.createDataFrame([(i, m[i].tolist()) for i in range(3)], "qid long, qvec array<float>").write.parquet(source)
    stream = spark.readStream.schema("qid long, qvec array<float>").parquet(source)
    got = []
    query = search_stream(index, stream, 1, lambda df, n: got.extend(df.collect()), str(tmp_path / "check"), available_now=True)
    query.awaitTermination(120)
    assert sorted((r.qid, r.row_id) for r in got) == [(0, 0), (1, 1), (2, 2)]
