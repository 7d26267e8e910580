"""Chat formatting, WARC archives, URL filters and the pipeline."""

import hashlib
import struct
import zipfile
from collections import Counter

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lithos.llm import chat_format, url_filter, warc
from lithos.llm.queries import QUERIES
from lithos.llm.sql import ORACLES

text = st.lists(st.sampled_from([*"<|>[]/\\sINST im_start\nend", "é", "</s>", "<|im_end|>", "[INST]"])).map("".join)


@given(text, text)
def test_template_is_reversible(role, said):
    turn, start, length = chat_format.render(role, said)
    assert list(chat_format.parse(turn + turn)) == [(role, said)] * 2
    assert chat_format.unescape(turn[start : start + length]) == said
    assert not any(c in chat_format.escape(said) for c in chat_format.CONTROL)


def test_events_fold(spark):
    log = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "message", "assistant", ""), (1, 1, 2, "delta", None, "Hel"), (1, 1, 3, "delta", None, "lo"),
        (1, 1, 9, "regenerate", None, None), (1, 1, 10, "delta", None, "Better"), (1, 0, 11, "edit", "user", "hi there"), (1, 2, 12, "message", "user", "x"), (1, 2, 13, "delete", None, None),
        (2, None, 0, "message", None, None), (2, 70, 1, "message", "user", "late"), (2, 70, 1, "message", "user", "late"), (None, 1, 1, "message", "assistant", "no id"),
    ]
    events = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    out = chat_format.format_conversations(events)
    said = {}
    for r in sorted(out.collect(), key=lambda r: (r.segment is not None, r.segment or 0, r.part)):
        said.setdefault(r.conv_id, []).extend(chat_format.parse(r.formatted))
    assert said == {1: [("user", "hi there"), ("assistant", "Better")], 2: [("", ""), ("user", "late"), ("user", "late")], None: [("assistant", "no id")]}
    by = {r.conv_id: r for r in chat_format.digests(out).collect()}
    assert by[1].loss_chars == 6 and by[1].loss_sha256 == hashlib.sha256(b"Better").hexdigest()
    assert chat_format.digests(chat_format.format_conversations(events.filter("false"))).count() == 0


@pytest.mark.parametrize("name", ["op1_chat_format", "op5_warc", "op9_url_filter"])
def test_sql_on_hard_rows(spark, sf, tmp_path, name):
    odd = ["http://A.Example.COM/EN/x?y#z", "x://example.com/en/a", "http://www.example.com/en/", "http://com?x", "http://a.net/es/", None, "no scheme", "a://b://c/d", "http://a.co.uk/", "http:///p", "h://com/\nfr", "http://İ.net/fr/"]
    html = ["same", "same", None, "", "é\U0001f600", "x" * 300_000]
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    pages.unionByName(spark.createDataFrame([(10_000 + i, u, html[i % len(html)]) for i, u in enumerate(odd)], pages.schema)).write.parquet(f"{tmp_path}/pages.parquet")
    turns = spark.createDataFrame([(9_000, None, None, None), (9_000, 3, "assistant", "\\<s> [INST]\\"), (9_000, 200, "tool\nx", "a\nb"), (9_000, 200, "tool\nx", "a\nb"), (9_001, 0, "user", ""), (None, 1, "assistant", "é")], "conv_id long, turn long, role string, text string")
    spark.read.parquet(f"{sf}/conversations.parquet").unionByName(turns).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_archives_are_zip_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}\r\nx", f"<p>{i // 2}</p>" * 50) for i in range(40)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    out = {r.page_id: r for r in warc.round_trip(pages.repartition(2), folder=folder).collect()}
    assert len(out) == 40 and out[6].record_type == "response" and out[7].refers_to == 6 and out[7].payload is None
    assert out[6].url == "http://h/6\r\nx" and bytes(out[6].payload).decode() == "<p>3</p>" * 50
    names = list((tmp_path / "w").iterdir())
    with zipfile.ZipFile(names[0]) as z:
        assert z.testzip() is None and {i.filename: i.compress_type for i in z.infolist()} == {warc.DATA: 0, warc.INDEX: 0}


def test_directories_of_other_writers(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x", b"stored")
        z.writestr("y", b"packed" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\5\6 in a note"
    raw = (tmp_path / "a.zip").read_bytes()
    z64 = warc.local_header(b"m", 4, 0, True) + b"data"
    z64 += warc.directory([(b"m", 4, 0, 0)], len(z64), True)
    (_, at, n) = warc.central_directory(lambda o, k: z64[o : o + k], len(z64))["m"]
    assert z64[at : at + n] == b"data"
    assert struct.unpack_from("<I", z64, len(z64) - 6)[0] == 0xFFFFFFFF
    with pytest.raises(ValueError):
        warc.central_directory(lambda o, k: b"x" * k, 100)
    try:
        found = warc.central_directory(lambda o, k: raw[o : o + k], len(raw))
        assert raw[found["x"][1] :][:6] == b"stored" and found["y"][0] == 8
    except struct.error as e:
        pytest.fail(str(e))


def test_reputation_shrinks(spark):
    rows = [("bad.site.org", 1)] * 40 + [("new.site.org", 0)] + [(f"h{i}.good.org", 0) for i in range(60)] + [("lonely.other.org", 1)]
    by = {r.host: r for r in url_filter.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert by["bad.site.org"].mean - 1.64 * by["bad.site.org"].spread > 0.5
    assert by["lonely.other.org"].mean - 1.64 * by["lonely.other.org"].spread < 0.5
    assert by["h1.good.org"].mean < by["new.site.org"].mean < by["bad.site.org"].mean
    pages = spark.createDataFrame([(1, None), (2, "http://q.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert {r.verdict for r in url_filter.judge_urls(pages, none).collect()} == {"allow"}


def test_pipeline_against_brute_force(spark, sf):
    import re
    from collections import defaultdict

    import corpus_pipeline
    from lithos.llm import decontaminate

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "mixing"]
    kept = stages["quality_rules"](spark, docs, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0] for r in con.sql(f"SELECT doc_id FROM ({ORACLES['op6_quality_rules']}) WHERE kept").fetchall()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns
    lines = stages["line_dedup"](spark, kept, sf)
    assert lines.columns == docs.columns and lines.count() == len(want)
    near = stages["near_dedup"](spark, lines, sf)
    sets = {}
    for r in lines.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text.lower())
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i in ids:
        groups[find(i)].append(i)
    assert sorted(r.doc_id for r in near.collect()) == sorted(groups) and near.columns == docs.columns
    clean = stages["decontamination"](spark, near, sf)
    left = {r.doc_id: r for r in clean.collect()}
    hits = decontaminate.digests(decontaminate.find_windows(clean, spark.read.parquet(f"{sf}/benchmark.parquet"))).filter("contaminated").count()
    assert hits == 0 and set(left) <= set(groups) and all(r.n_chars == len(r.text) for r in left.values())
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_empty_and_clashing_pages(spark):
    from lithos.llm import url_filter, warc

    schema = "page_id long, url string, html string, host string, path string, payload string"
    none = spark.createDataFrame([], schema)
    labels = spark.createDataFrame([], "page_id long, bad int")
    assert warc.round_trip(none.select("page_id", "url", "html"), least=0).count() == 0
    assert url_filter.judge_urls(none, labels).count() == 0
    some = spark.createDataFrame([(1, "http://a.com/x", "<p>", "h", "p", "y"), (2, None, None, None, None, None), (2, "http://h" + "o" * 50_000 + ".net/es/", "", "h", "p", "y")], schema)
    got = sorted((r.page_id, r.host or "", r.rule or "", r.verdict) for r in url_filter.judge_urls(some, labels).collect())
    assert got == [(1, "a.com", "com/", "allow"), (2, "", "", "allow"), (2, "h" + "o" * 50_000 + ".net", "net/es/", "block")]


def test_long_turns(spark):
    from lithos.llm import chat_format

    text = "[INST] \\ </s> " * 40_000
    events = spark.createDataFrame([(1, 0, 0, "message", "user", "q", "x"), (1, 1, 0, "message", "assistant", text, "x"), (1, 2, 0, "message", "user", None, "x")], "conv_id long, turn long, seq long, kind string, role string, text string, formatted string")
    d = chat_format.digests(chat_format.format_conversations(events)).first()
    assert (d.n_turns, d.loss_chars) == (3, len(text))
