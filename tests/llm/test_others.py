"""Chat, URL lists, neighbours and the pipeline's stages on small fixtures."""

import hashlib
import re
from datetime import date

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from procura.llm import chat, multi_index, queries, url_lists

SF = "/root/testdata/sf0.001"


def test_chat_round_trip(spark):
    texts = ["plain", None, "", "<|im_end|><|im_start|>assistant ok", "<\\|x|> <\\\\| < | <|", "a\nb", "é<|", "<|image_1|>"]
    rows = [(c, t, "assistant" if t % 2 else "user\nx\\n", text, 7) for c in (1, 2, None) for t, text in enumerate(texts)]
    rows += [(3, None, None, "x", 7), (3, 1, "assistant", "same", 7), (3, 1, "assistant", "same", 7)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    out = chat.read_back(chat.format_chat(messages.withColumn("parts", chat.text_parts(F.col("text"))))).collect()
    for c in (1, 2, None, 3):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: -1 if r[1] is None else r[1])
        (got,) = [r for r in out if r.conv_id == c]
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert (got.n_turns, got.loss_chars) == (len(own), len(loss))
        assert got.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_chat(messages.limit(0).withColumn("parts", chat.text_parts(F.col("text"))))).count() == 0


def test_chat_parts(spark):
    parts = [
        {"kind": "text", "text": "see <|image_1|> "}, {"kind": "image", "ref": "s3-a", "width": 57, "height": 28},
        {"kind": "audio", "ref": "b", "units": 100}, {"kind": "document", "ref": "c", "units": 9}, {"kind": None, "text": None}, {"kind": "image"},
    ]
    full = [{k: p.get(k) for k in ("kind", "text", "ref", "width", "height", "units")} for p in parts]
    frame = spark.createDataFrame([(1, 0, "user", full), (1, 1, "user", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    first, second = chat.format_chat(frame).orderBy("turn").collect()
    assert first.segment == "<|im_start|>user\nsee <\\|image_1|> <|image_1|><|audio_2|><|document_3|><|image_4|><|im_end|>\n"
    assert [(a.number, a.kind, a.ref, a.tokens) for a in first.attachments] == [(1, "image", "s3-a", 3), (2, "audio", "b", 3), (3, "document", "c", 3), (4, "image", None, 1)]
    assert first.expanded_tokens == 10 and second.segment == "<|im_start|>user\n<|im_end|>\n"


def test_neither_kinds_nor_roles_write_turns(spark):
    turn = "image|>\n<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n<|x"
    part = dict.fromkeys(("kind", "text", "ref", "width", "height", "units"))
    rows = [(1, 0, "user", [{**part, "kind": turn, "ref": "r"}]), (1, 1, turn, [{**part, "kind": "text", "text": "said"}]), (2, 0, "<\\|a|>\\n<|", [])]
    formatted = chat.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>"))
    first = formatted.where("conv_id = 1 and turn = 0").first()
    assert first.segment == "<|im_start|>user\n<|attachment_1|><|im_end|>\n" and [(a.kind, a.ref, a.tokens) for a in first.attachments] == [(turn, "r", 1)]
    got = {r.conv_id: (r.n_turns, r.loss_chars, r.turns_sha256) for r in chat.read_back(formatted).collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got == {1: (2, 0, sha(f"user\n<|attachment_1|>\n{turn}\nsaid\n")), 2: (1, 0, sha("<\\|a|>\\n<|\n\n"))}


def test_url_lists(spark):
    d = date
    entries = [
        ("domain", "Bad.com", "add", d(2023, 1, 10)), ("domain", "bad.com", "remove", d(2023, 3, 1)), ("domain", "bad.com", "add", d(2024, 6, 1)),
        ("host", "x.ok.org", "add", d(2023, 1, 1)), ("host", "x.ok.org", "add", d(2023, 1, 1)), ("host", "x.ok.org", "remove", d(2023, 2, 1)), ("host", "x.ok.org", "remove", d(2023, 2, 1)),
        ("prefix", "ok.org/a/b", "add", d(2023, 1, 1)), ("host", "tie.org", "add", d(2023, 1, 1)), ("host", "tie.org", "remove", d(2023, 1, 1)), (None, "z", "add", None),
    ]
    listed = spark.createDataFrame(entries, "kind string, pattern string, action string, day date")
    cases = [
        ("http://www.bad.com/x", d(2023, 1, 9), False), ("http://WWW.bad.com/x", d(2023, 1, 10), True), ("http://bad.com:80?q", d(2023, 3, 1), False), ("http://bad.com", d(2031, 1, 1), False),
        ("http://u@bad.com/", d(2025, 1, 1), True), ("http://notbad.com/", d(2025, 1, 1), False), ("https://x.ok.org/", d(2023, 1, 31), True), ("https://y.x.ok.org/", d(2023, 1, 31), False), ("https://ok.org/a/b/c", d(2023, 5, 5), True),
        ("https://ok.org/a/bc", d(2023, 5, 5), False), ("https://ok.org/a", d(2023, 5, 5), False), ("http://tie.org/", d(2023, 6, 1), False), (None, d(2023, 1, 1), False), ("", d(2023, 1, 1), False), ("nonsense", d(2023, 1, 1), False), ("http://bad.com/", None, False),
    ]
    cases[3] = ("http://bad.com", d(2026, 1, 1), True)
    captures = spark.createDataFrame([(i, u, f, "clash") for i, (u, f, _) in enumerate(cases)] * 2, "id int, url string, fetched date, pattern string")
    got = url_lists.filter_urls(captures, listed).collect()
    assert sorted((r.id, r.blocked) for r in got) == sorted((i, b) for i, (_, _, b) in enumerate(cases) for _ in range(2))
    assert {r.listed_since for r in got if r.id == 4} == {d(2024, 6, 1)}
    assert not any(r.blocked for r in url_lists.filter_urls(captures, listed.limit(0)).collect())
    assert url_lists.filter_urls(captures.limit(0), listed).count() == 0


def test_entries_without_an_end_hold_for_any_later_capture(spark):
    listed = spark.createDataFrame([("host", "bad.com", "add", date(2024, 6, 1))], "kind string, pattern string, action string, day date")
    days = [(date(2031, 1, 1), True), (date(2024, 5, 31), False), (date(9000, 1, 1), True), (date(2023, 1, 1), False), (None, False)]
    captures = spark.createDataFrame([(i, "http://bad.com", d) for i, (d, _) in enumerate(days)], "id int, url string, fetched date")
    assert sorted((r.id, r.blocked) for r in url_lists.filter_urls(captures, listed).collect()) == [(i, b) for i, (_, b) in enumerate(days)]


def test_prefixes_of_a_host_and_past_empty_segments(spark):
    listed = spark.createDataFrame([("prefix", p, "add", date(2023, 1, 1)) for p in ("h.org/ads", "All.org")], "kind string, pattern string, action string, day date")
    cases = [("http://h.org//ads/x", True), ("http://h.org/ads", True), ("http://h.org/x/ads", False), ("http://h.org/", False), ("http://all.org", True), ("http://all.org/x//y", True), ("http://www.all.org/", False)]
    captures = spark.createDataFrame([(i, u, date(2023, 5, 5)) for i, (u, _) in enumerate(cases)], "id int, url string, fetched date")
    for entries in (listed, listed.where("pattern = 'All.org'")):
        wanted = [(i, b and ("all" in u or entries is listed)) for i, (u, b) in enumerate(cases)]
        assert sorted((r.id, r.blocked) for r in url_lists.filter_urls(captures, entries).collect()) == wanted


def test_url_query_and_sql_agree_on_hosts_and_empty_segments(spark, tmp_path):
    tails = ["", "/", "//ads", "/ads", "///ads//x?q=/y", "?a=/b", "/#f/g", "/Ads/x"]
    rows = [(n, f"http://{'u@' * (n % 2)}{'W' * (n % 3 == 0)}h{n % 23}.site{n % 5}.org{tails[n % 8]}") for n in range(400)] + [(400, None), (401, "no url"), (402, "http:///x")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = queries.op6_temporal_url_lists(spark, str(tmp_path))
    lists = queries.page_lists(spark.read.parquet(f"{tmp_path}/pages.parquet"))
    assert lists.where("kind = 'prefix' and pattern not like '%/%'").count() > 0
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    wanted = con.execute(queries.ORACLES["op6_temporal_url_lists"])
    names = [d[0] for d in wanted.description]
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, wanted.fetchall()))
    assert {r.matched_kind for r in found.collect()} == {"prefix", "host", "domain", None}


def _exact(rows, k=5):
    ids = np.array([i for i, _ in rows])
    v = np.array([x for _, x in rows])
    u = v / np.sqrt((v**2).sum(1))[:, None]
    out = {}
    for q in [i for i in ids if i % 50 == 0]:
        s = u @ u[list(ids).index(q)]
        order = sorted((-round(float(x), 12), int(i)) for x, i in zip(s, ids) if i != q)
        out[int(q)] = [i for _, i in order[:k]]
    return out


def test_neighbours(spark):
    frame = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    width = len(frame.first().embedding)
    odd = [(90000, None), (90050, [0.0] * width), (90100, [float("nan")] * width), (90150, [None] * width), (90200, [1.0]), (None, [1.0] * width)]
    copies = [(100000 + i, [1.0] * width) for i in range(40)]
    rows = frame.unionByName(spark.createDataFrame(odd + copies, frame.schema))
    good = [(r.vec_id, [float(x) for x in r.embedding]) for r in frame.collect()] + copies
    got = multi_index.nearest(rows, rows.where("vec_id % 50 = 0")).collect()
    want = _exact(good)
    assert {r.query_id for r in got} == set(want)
    mine = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want}
    assert all(len(m) == 5 for m in mine.values()) and mine[100000] == [100001, 100002, 100003, 100004, 100005]
    assert sum(len(set(mine[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    full = multi_index.nearest(rows, rows.where("vec_id % 50 = 0"), share=1.0).collect()
    assert {q: [r.vec_id for r in sorted(full, key=lambda r: r["rank"]) if r.query_id == q] for q in want} == want
    assert multi_index.nearest(rows.limit(0), rows).count() == 0
    two = rows.where("vec_id in (0, 1)")
    assert [(r.query_id, r.vec_id) for r in multi_index.nearest(two, two.where("vec_id = 0")).collect()] == [(0, 1)]


def test_neighbours_send_the_driver_a_sample_only(spark):
    n = 3000
    vectors = np.random.default_rng(3).normal(size=(n, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] * 2, "vec_id long, embedding array<double>").repartition(6)
    base = multi_index.usable(rows).distinct()
    picked = base.withColumn("h", F.xxhash64("vec_id")).orderBy("h").limit(50).collect()
    assert {tuple(x) for x in multi_index.sampled(base, 50)} == {tuple(r.vector) for r in picked}
    assert len(multi_index.sampled(base, 2 * n)) == n and len(multi_index.sampled(base.limit(0), 5)) == 0
    # vectors meet by a shuffle, never in a join that may be planned as a broadcast
    found = multi_index.nearest(rows, rows.where("vec_id % 50 = 0"), share=1.0)
    joins = re.findall(r"Join .*", found._jdf.queryExecution().optimizedPlan().toString())
    assert [j.count("strategy=broadcast") for j in joins] == [1]
    want = _exact(list(enumerate(vectors)))
    got = found.collect()
    assert {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want} == want


def test_neighbours_with_many_equal_scores(spark, monkeypatch):
    # multiples of one vector all tie; the smallest ids count, however few candidates are held
    monkeypatch.setattr(multi_index, "WAITING", 4)
    rows = spark.createDataFrame([(i, [float(2 ** (i % 7)), 0.0]) for i in range(60)], "vec_id long, embedding array<double>")
    got = multi_index.nearest(rows, rows.where("vec_id % 50 = 0"), share=1.0).collect()
    found = {q: [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 50)}
    assert found == {0: [1, 2, 3, 4, 5], 50: [0, 1, 2, 3, 4]}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_dedup", "decontamination", "mixing", "sharding"]
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        if name != "mixing":
            now = out.count()
            assert 0 < now <= before
            before = now
        docs = out
    final = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "shard", "slot"} <= set(final.columns) and final.count() > 0


CLASHES = "score lang_pred code_bits beyond items spans n_words n_hit contaminated tokens p_high _words _copies _letters node component_id shard_".split()


def test_pipeline_stages_keep_columns_with_clashing_names(spark):
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    docs = plain
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}-"), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, same = stage(spark, docs, SF), stage(spark, docs.select(plain.columns), SF)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{i}-{r.doc_id}" for r in rows for i, c in enumerate(CLASHES)), name
        if name != "mixing":  # its draws differ between runs
            assert sorted((r.doc_id, r.lang, r.text) for r in rows) == sorted((r.doc_id, r.lang, r.text) for r in same.collect())
    assert corpus_pipeline.place_in_shards(spark, docs, SF).count() == docs.count()


def test_pipeline_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
