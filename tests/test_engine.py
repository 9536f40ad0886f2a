import io
import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from corpuslake import schemas
from corpuslake.config import EngineConfig
from corpuslake.engine import Engine
from corpuslake.operators import evaluate, sessions
from corpuslake.sources import clients, datasets, docx, files, pdf
from corpuslake.streaming import ingest


def make_docx(paragraphs, table):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>")
    return out.getvalue()


def paragraphs(word, n=12):
    return "\n\n".join(f"{word} paragraph {i} " + " ".join(f"{word}{i}{j}" for j in range(20)) for i in range(n))


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "docs"
    (folder / "sub").mkdir(parents=True)
    (folder / "b.txt").write_text(paragraphs("alpha"), "utf-8")
    (folder / "a.md").write_text("# Title\n\n**bold** beta words here\n", "utf-8")
    (folder / "sub" / "c.txt").write_bytes("中文检索 gamma".encode("gbk"))
    (folder / "d.docx").write_bytes(make_docx(["delta   text", " "], [["h1", "h2"], ["", ""], ["1", "2"]]))
    (folder / "empty.txt").write_bytes(b"")
    (folder / "x.bin").write_bytes(b"1")
    return folder


def test_scan_and_load(spark, root):
    found = files.validated(files.scan(spark, f"file://{root}"))
    rows = {r.path.rsplit("/", 1)[1]: r.text for r in files.load(found).select("path", "text").collect()}
    assert set(rows) == {"a.md", "b.txt", "c.txt", "d.docx"}
    assert rows["a.md"] == "Title\n\nbold beta words here" and rows["c.txt"] == "中文检索 gamma"
    assert rows["d.docx"] == "delta text\nh1 | h2\n---\n1 | 2"
    assert files.scan(spark, f"file://{root}/missing").count() == 0


def test_decoding(spark):
    data = [b"\xef\xbb\xbfbom", "é".encode(), "中".encode("gbk"), b"\xff\xfe\x81", None, b""]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, content binary")
    got = [r.t for r in df.select("i", files.decoded(F.col("content")).alias("t")).orderBy("i").collect()]
    assert got == ["bom", "é", "中", "ÿþ\x81", None, ""]


def test_docx_of_broken_files():
    assert docx.parse(b"no zip") == "" and docx.parse(None) == ""
    assert docx.table_rows([["a\n b", "c"]]) == ["a b | c"]


def test_pdf_lines(spark, tmp_path):
    def parser(content):
        for page, body in enumerate(content.decode().split("\f"), 1):
            yield pdf.Line(page, 2.0, 100.0, "Running head")
            for i, t in enumerate(body.split("\n")):
                yield pdf.Line(page, 30.0 + i, 100.0, t)

    (tmp_path / "f.pdf").write_text("intro\na\tb\f1\t2\nend\flast")
    df = files.scan(spark, f"file://{tmp_path}")
    rows = pdf.page_texts(pdf.lines_of(df, parser)).orderBy("page").collect()
    assert [(r.page, r.text) for r in rows] == [(1, "intro\na\tb\n1\t2\nend"), (2, "last")]
    assert files.load(df, parser).first()["text"] == "intro\na\tb\n1\t2\nend\n\nlast"


def test_a_pdf_that_fails_is_a_row(spark, tmp_path):
    def parser(content):
        yield pdf.Line(1, 30.0, 100.0, " ".join(content.decode() * 9))
        if content == b"broken":
            raise ValueError("no trailer")

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.pdf").write_bytes(b"whole")
    (tmp_path / "docs" / "b.pdf").write_bytes(b"broken")
    e = Engine(spark, f"file://{tmp_path}/home", pdf_parser=parser)
    assert e.index(f"file://{tmp_path}/docs").first()["files"] == 1
    assert [(r.source.rsplit("/", 1)[1], r.stage, r.error) for r in e.failures.collect()] == [("b.pdf", "load", "no trailer")]
    (tmp_path / "docs" / "b.pdf").write_bytes(b"mended")
    assert e.index(f"file://{tmp_path}/docs").first()["files"] == 1


def test_texts_are_sent_once(spark, root, tmp_path, server):
    host, asked = server
    e = Engine(spark, f"file://{tmp_path}/home", embedder=clients.HttpEmbedder(host, "e", many=4), config=EngineConfig(cosine_duplicate=2.0))
    e.index(f"file://{root}")
    sent = [t for path, b in asked if path == "/api/embed" for t in b["input"]]
    assert len(sent) == len(set(sent)) == e.vectors.count() > 4 and any(len(b["input"]) > 1 for _, b in asked)
    n = len(asked)
    e.index(f"file://{root}", force=True)
    assert len(asked) == n and e.chunks.filter("is_active AND embedding IS NULL").isEmpty()
    (root / "a.md").write_text("poison", "utf-8")
    (root / "e.txt").write_text("epsilon", "utf-8")
    assert e.index(f"file://{root}").first()["files"] == 1
    assert [r.source.rsplit("/", 1)[1] for r in e.failures.collect()] == ["a.md"]
    assert {r.is_active for r in e.chunks.filter("file_name = 'a.md' AND version = 2").collect()} == {True}


def test_requests_are_tried_again(server):
    host, asked = server
    assert clients.HttpEmbedder(host, "shaky", many=2, wait=0.01).embed(["a", "bb", "ccc"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]]
    assert len(asked) == 6
    shaky = clients.HttpEmbedder(host, "e", many=8, retries=0)
    assert [v is None for v, _ in clients.tried(shaky, ["a", "poison", "b"])] == [False, True, False]


def test_index_search_and_versions(spark, root, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/home")
    counts = e.index(f"file://{root}").first()
    assert counts["files"] == 4 and e.stats().first()["sources"] == 4
    assert e.index(f"file://{root}").first()["files"] == 0
    top = e.search(["gamma", "alpha3 alpha31"], top_k=2).filter("rank = 1").orderBy("query_id").collect()
    assert "gamma" in top[0].document and "alpha31" in top[1].document
    answers = e.ask(["gamma", " "]).orderBy("query_id").collect()
    assert answers[0].stopped is None and answers[0].answer and answers[1].stopped == "blank question" and answers[1].answer is None

    (root / "b.txt").write_text(paragraphs("omega", 3), "utf-8")
    e.index(f"file://{root}")
    states = {r.is_active for r in e.chunks.filter(F.col("file_name") == "b.txt").select("is_active").distinct().collect()}
    assert states == {True, False}

    e.index(f"file://{root}", force=True)
    doc = e.chunks.filter(F.col("file_name") == "a.md").first()["doc_id"]
    assert [r.version for r in e.versions(doc).collect()] == [2, 1] and e.active_version(doc) == 2
    assert e.rollback(doc, 1) and not e.rollback(doc, 9) and e.active_version(doc) == 1
    assert {(r.version, r.is_active) for r in e.chunks.filter(F.col("doc_id") == doc).collect()} == {(1, True), (2, False)}

    details, summary = e.evaluate_recall(spark.createDataFrame([(0, "gamma", ["gamma"])], "query_id bigint, question string, relevant_texts array<string>"))
    assert summary.first()["recall_1"] == 1.0

    source = e.chunks.filter(F.col("file_name") == "c.txt").first()["source"]
    assert e.delete(source) > 0 and e.delete(source) == 0
    assert e.delete_all() > 0 and e.chunks.count() == 0


def test_stream_takes_new_files_and_a_batch_replaces_sources(spark, root, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/home2")
    for name in ("b.txt", "new.txt"):
        (root / name).write_text(paragraphs(name[0] + "word"), "utf-8")
        ingest.start(e, f"file://{root}", f"file://{tmp_path}/cp", once=True).awaitTermination()
    assert e.stats().first()["sources"] == 5
    (root / "b.txt").write_text(paragraphs("omega"), "utf-8")
    e.index_files(files.scan(spark, f"file://{root}"), replace=True)
    rows = e.chunks.filter(F.col("file_name") == "b.txt").select("document").collect()
    assert rows and all("omega" in r.document for r in rows) and e.stats().first()["sources"] == 5


def test_a_batch_counts_once(spark, root, tmp_path, monkeypatch):
    """Run twice, or stopped at some step and run again, a batch leaves the rows of one run."""
    for name in ("b.txt", "d.docx", "empty.txt"):
        (root / name).unlink()
    (root / "odd [1]*.txt").write_text("odd name", "utf-8")
    whole = spark.read.format("binaryFile").schema(files.BINARY).option("recursiveFileLookup", True).load(f"file://{root}").select(*ingest.LISTING)

    def state(e):
        chunks = sorted((r.file_name, r.chunk_index, r.version, r.is_active) for r in e.chunks.collect())
        log = sorted((r.file_name, r.version, r.chunk_count) for r in e.log.collect())
        return chunks, log, sorted((r.path, r.reason, r.batch_id) for r in ingest.refusals(e).collect()), [(r.files, r.refused, r.batch_id) for r in ingest.batches(e).collect()]

    plain = Engine(spark, f"file://{tmp_path}/plain")
    assert ingest.take(plain, whole, 7, "s") and not ingest.take(plain, whole, 7, "s")
    want = state(plain)
    assert any(name == "odd [1]*.txt" for name, *_ in want[0]) and [r[1] for r in want[2]] == ["unknown file type"]
    for step in ("_retire", "_record"):  # before and after the chunks are stored
        e = Engine(spark, f"file://{tmp_path}/{step}")

        def broken(*_):
            raise RuntimeError("lost")

        with monkeypatch.context() as m:
            m.setattr(Engine, step, broken)
            try:
                ingest.take(e, whole, 7, "s")
            except RuntimeError:
                assert ingest.batches(e).isEmpty()
        ingest.take(e, whole, 7, "s")
        assert state(e) == want, step


def test_clients_fall_back():
    class Broken(clients.EchoModel):
        def chat(self, prompt):
            raise RuntimeError("down")

        def generate(self, prompt):
            return "plain"

        def stream(self, prompt):
            raise RuntimeError("down")
            yield

    assert clients.answer(Broken(), "p") == "plain"
    assert list(clients.answer_stream(Broken(), "p")) == ["plain"]
    assert "".join(clients.answer_stream(clients.EchoModel(), "a\n\nb\n\nc d")).strip() == "c d"


def test_datasets(spark, tmp_path):
    (tmp_path / "d.json").write_text('[{"question": "q", "relevant_texts": ["a"]}]')
    assert datasets.load_dataset(spark, f"file://{tmp_path}/d.json").first()["question"] == "q"
    (tmp_path / "s.json").write_text('{"name": "n", "created_at": "t", "messages": [{"role": "user", "content": "c"}]}')
    assert datasets.load_sessions(spark, f"file://{tmp_path}/s.json").first()["messages"][0]["role"] == "user"
    assert datasets.builtin_dataset(spark).count() == 3


def test_history_of_fingerprints(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "a.txt").write_text(paragraphs("alpha"), "utf-8")
    (tmp_path / "two" / "b.txt").write_text(paragraphs("alpha") + "\n\nand a new end", "utf-8")
    e = Engine(spark, f"file://{tmp_path}/home")
    first = e.index(f"file://{tmp_path}/one").first()["chunks"]
    assert e.fingerprints.count() == first
    assert e.index(f"file://{tmp_path}/two", history=True).first()["chunks"] < first


def test_faithfulness(spark):
    class Judge(clients.EchoModel):
        def chat(self, prompt):
            if "boom" in prompt:
                raise RuntimeError("down")
            return '{"claims": [{"text": "x"}], "summary": {"total_claims": 1, "supported": 1, "faithfulness_score": 1.0}}'

        generate = chat

    df = spark.createDataFrame([(1, "q", "c", "a"), (2, "q", "c", " "), (3, "q", "", "a"), (4, "boom", "c", "a")], "id int, question string, context string, answer string")
    rows = {r.id: r for r in evaluate.faithfulness(df, Judge()).collect()}
    assert [rows[i].faithfulness_score for i in (1, 2, 3)] == [1.0, 1.0, 0.0]
    assert rows[1].error is None and rows[2].error == "blank answer" and rows[3].unsupported == 1 and "down" in rows[4].error


def test_sessions(spark):
    s = spark.createDataFrame([], schemas.SESSIONS)
    s = sessions.created(sessions.created(sessions.created(s, "a", "2020"), "b", "2021"), "a", "2022")
    kind = "name string, seq int, role string, content string, sources array<struct<index:int,file:string,path:string,score:double,snippet:string>>"
    new = spark.createDataFrame([("a", 2, "assistant", "yes", None), ("a", 1, "user", "ok?", None)], kind)
    s = sessions.renamed(sessions.appended(s, new), "a", "c")
    assert {r.name: r.turns for r in sessions.turns(s).collect()} == {"b": 0, "c": 1}
    assert sessions.latest(s).first()["name"] == "b" and sessions.deleted(s, "b").count() == 1
    assert [m.content for m in s.filter("name = 'c'").first().messages] == ["ok?", "yes"]


def files_under(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("*") if p.is_file()}


def test_searches_read_what_indexing_wrote(spark, root, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/home")
    e.index(f"file://{root}")
    before = files_under(tmp_path / "home")
    first = [tuple(r) for r in e.search(["gamma", "alpha3"], top_k=3).collect()]
    assert [tuple(r) for r in e.search(["gamma", "alpha3"], top_k=3).collect()] == first
    assert files_under(tmp_path / "home") == before

    (root / "new.txt").write_text(paragraphs("sigma"), "utf-8")  # appended: what was written stays as it is
    e.index(f"file://{root}")
    after = files_under(tmp_path / "home")
    kept = {k: v for k, v in before.items() if k.startswith(("search/store/part", "search/postings/part", "chunks/bucket="))}
    assert {k.split("/")[0] for k in kept} == {"search", "chunks"}
    assert kept and all(after[k] == v for k, v in kept.items())
    assert "sigma" in e.search(["sigma3 sigma31"], top_k=1).first()["document"]
    rows, index = e.search_tables()
    assert rows.count() == rows.select("doc").distinct().count() == index.lengths.count() == index.stats.first()["n"] == e.chunks.count()

    appended = {(r.document, r.score) for r in e.search(["sigma3 alpha3"], top_k=5).collect()}
    e.refresh()
    assert {(r.document, r.score) for r in e.search(["sigma3 alpha3"], top_k=5).collect()} == appended
    e.delete(e.chunks.filter("file_name = 'new.txt'").first()["source"])
    assert not e.search(["sigma3"], top_k=5).filter("document LIKE '%sigma%'").count()


def test_vector_layer_while_indexing(spark, tmp_path):
    class Same(clients.HashEmbedder):
        def embed(self, texts):
            return [[1.0, 0.0] if "alike" in t else [0.0, float(len(t))] for t in texts]

    for name, text in (("one", "alike first text"), ("two", "alike but in quite other words"), ("three", "of its own")):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.txt").write_text(text, "utf-8")
    e = Engine(spark, f"file://{tmp_path}/home", embedder=Same())
    assert [e.index(f"file://{tmp_path}/{n}").first()["chunks"] for n in ("one", "two", "three")] == [1, 0, 1]
    assert e.index(f"file://{tmp_path}/one", force=True).first()["chunks"] == 1  # its own archived chunk doesn't count


def test_versions_by_source_and_faithfulness(spark, root, tmp_path, capsys, monkeypatch):
    from corpuslake import cli

    e = Engine(spark, f"file://{tmp_path}/home")
    for force in (False, True):
        e.index(f"file://{root}", force=force)
    assert [r.version for r in e.source_versions(f"{root}/a.md").collect()] == [2, 1] == [r.version for r in e.source_versions("a.md").collect()]
    assert e.rollback_source("a.md", 1) and not e.rollback_source("a.md", 7) and not e.rollback_source("none.md", 1)
    report = e.evaluate_faithfulness(["gamma"]).first()
    assert report["question"] == "gamma" and report["error"]
    monkeypatch.setattr(cli, "session", lambda: spark)
    home = ["--home", f"file://{tmp_path}/home"]
    assert cli.main([*home, "versions", "a.md"]) == 0 and cli.main([*home, "rollback", "a.md", "2"]) == 0 and cli.main([*home, "rollback", "a.md", "9"]) == 1
    assert cli.main([*home, "eval", "faithfulness", "gamma"]) == 0 and cli.main([*home, "eval", "recall"]) == 0
    assert cli.main([*home, "query", "gamma", "--threshold", "0.1"]) == 0
    assert "faithfulness_score" in capsys.readouterr().out


def test_hits_under_the_threshold_fill_up(spark, root, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/home")
    e.index(f"file://{root}")
    assert e.prompts(["gamma"]).first()["context"] == e.prompts(["gamma"], threshold=0.0).first()["context"]
    assert e.search(["gamma"], threshold=0.35, backfill=False).count() == 0


@pytest.fixture
def server():
    """A model server's endpoints, with what it was asked."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body))
            if body.get("model") == "broken" and self.path == "/api/chat":
                self.send_error(500)
                return
            if body.get("model") == "shaky" and len([1 for _, b in asked if b == body]) < 3:
                self.send_error(503)
                return
            if self.path == "/api/embed":
                if "poison" in body["input"]:
                    self.send_error(400)
                    return
                lines = [{"embeddings": [[float(len(t)), 1.0] for t in body["input"]]}]
            elif self.path == "/api/embeddings":
                lines = [{"embedding": [float(len(body["prompt"])), 1.0]}]
            elif self.path == "/api/generate":
                lines = [{"response": " generated "}]
            else:
                said = body["messages"][-1]["content"]
                lines = [{"message": {"content": w + " "}} for w in said.split()] + [{"done": True}] if body["stream"] else [{"message": {"content": f" to {said} "}}]
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"\n".join(json.dumps(x).encode() for x in lines))

        def log_message(self, *_):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}", asked
    made.shutdown()


def test_http_clients(spark, server):
    host, asked = server
    model = clients.HttpModel(host, "m", temperature=0.3, system="Be brief.")
    assert model.chat("Be brief.\n\nhello") == "to hello" and model.generate("x") == "generated"
    assert list(model.stream("one two")) == ["one ", "two "]
    assert [m["role"] for m in asked[0][1]["messages"]] == ["system", "user"] and asked[0][1]["options"] == {"temperature": 0.3}
    assert clients.answer(clients.HttpModel(host, "broken"), "p") == "generated"
    assert list(clients.answer_stream(clients.HttpModel(host, "broken"), "p")) == ["generated"]
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    rows = clients.embedded(df, clients.HttpEmbedder(host, "e"), "text").orderBy("id").collect()
    assert [r.embedding for r in rows] == [[3.0, 1.0], [0.0, 1.0]]
    assert {r.answer for r in clients.answered(df.withColumnRenamed("text", "prompt"), clients.HttpModel(host, "m")).collect()} == {"to abc", None}
    lost = clients.answered(df.withColumnRenamed("text", "prompt"), clients.HttpModel("http://127.0.0.1:9", "m")).orderBy("id").first()
    assert lost.answer is None and lost.answer_error


def test_sessions_and_refused_files(spark, tmp_path, root):
    kind = "name string, messages array<struct<role:string,content:string,sources:array<struct<index:int,file:string,path:string,score:double,snippet:string>>>>, created_at string"
    rows = [("a", [("user", "é?", None), ("assistant", "yes", [(1, "f", "/f", 0.5, "s")])], "2020"), ("b", [], None)]
    datasets.save_sessions(spark.createDataFrame(rows, kind), f"file://{tmp_path}/chats")
    assert sum(f.stat().st_size > 0 for f in (tmp_path / "chats").glob("*.json")) == 2
    back = {r.name: r for r in datasets.load_sessions(spark, f"file://{tmp_path}/chats").collect()}
    assert back["a"].messages[1].sources[0].snippet == "s" and back["b"].messages == [] and back["a"].messages[0].content == "é?"
    e = Engine(spark, f"file://{tmp_path}/home", config=EngineConfig(upload_limit_bytes=100))
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in ingest.refused(e, f"file://{root}").collect()}
    assert got["x.bin"] == "unknown file type" and got["b.txt"] == "over the upload limit" and "c.txt" not in got


def test_a_batch_that_failed_is_logged_by_the_next(spark, root, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/home")

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Engine, "_record", broken)
        with pytest.raises(RuntimeError, match="lost"):
            e.index(f"file://{root}")
    stored = e.chunks.count()
    assert stored and e.log.count() == 0
    assert e.index(f"file://{root}").first()["files"] == 0
    assert {(r.file_name, r.version, r.delta == r.chunk_count) for r in e.log.collect()} == {(n, 1, True) for n in ("a.md", "b.txt", "c.txt", "d.docx")}
    assert e.chunks.count() == stored == e.fingerprints.select("doc_id", "chunk_index").distinct().count()
    assert "gamma" in e.search(["gamma"], top_k=1).first()["document"]
