import hashlib
import tarfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepfield.llm import chat, gbt, media, q_chat, q_media, q_urls, urls


def test_png_round_trip():
    for n in (0, 1, 191, 192, 193, 10_000):
        payload = media.pad(bytes(i % 251 for i in range(n)))
        assert len(payload) % 192 == 0 and len(payload) >= 192
        png = media.encode_png(payload)
        assert media.decode_png(png) == payload
        assert media.png_header(png[:33]) == (64, len(payload) // 192, 8, 2)


def test_media_rows(spark, docs, shared):
    index = media.store_media(docs)
    rows = media.read_payloads(media.read_headers(index)).collect()
    assert len(rows) == docs.count()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in rows:
        payload = texts[r.doc_id] + b" " * ((-len(texts[r.doc_id])) % 192 or (0 if texts[r.doc_id] else 192))
        assert (r.n_bytes, r.payload_bytes) == (len(texts[r.doc_id]), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        with open(r.shard.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            stored = f.read(r.length)
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and r.media_bytes == len(stored) and r.height == len(payload) // 192
    for shard in {r.shard.removeprefix("file://") for r in rows}:
        with tarfile.open(shard) as t:
            assert all(m.name == hashlib.sha256(t.extractfile(m).read()).hexdigest() + ".png" for m in t.getmembers())


def test_media_damage_is_seen(spark, docs, shared):
    index = media.store_media(docs.limit(1))
    bad = index.withColumn("media_sha256", F.lit("0" * 64))
    with pytest.raises(Exception, match="damaged"):
        media.read_payloads(bad).collect()


def test_media_query_and_empty(spark, sf, empty, shared):
    assert media.read_payloads(media.store_media(empty)).count() == 0
    assert q_media.op1_media_columns(spark, sf).count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_forest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(int)
    forest = gbt.train(x[:2000], y[:2000])
    assert ((forest.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    slow = [forest.base + sum(_leaf(forest, t, row) for t in range(len(forest.leaf))) for row in x[:20]]
    np.testing.assert_allclose(forest.predict(x[:20]), 1 / (1 + np.exp(-np.array(slow))))
    assert gbt.train(np.zeros((0, 3)), np.zeros(0)).predict(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def _leaf(forest, t, row):
    node, inner = 0, forest.feature.shape[1]
    while node < inner:
        node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.cut[t, node])
    return forest.leaf[t, node - inner]


URLS = {
    "http://Www.Example.COM/en/7?x=1#f": ("www.example.com", "/en/7", "example.com/en/7", "allow"),
    "https://a.com/en/": ("a.com", "/en/", "com/en/", "block"),
    "http://example.net/de/81": ("example.net", "/de/81", "example.net/de/8", "block"),
    "http://x.net/de/81": ("x.net", "/de/81", "net/de/", "allow"),
    "http://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"),
    "http://h?q=/en/": ("h", "", None, None),
    "no scheme": ("", "", None, None),
    None: ("", "", None, None),
    "http://É.com/x": ("É.com", "/x", None, None),
    "a://b://c/d": ("b:", "//c/d", None, None),
}


def test_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    host, path = urls.split_url(F.col("url"))
    split = df.withColumns({"host": host, "path": path})
    rule, action = urls.decide(F.col("host"), F.col("path"), q_urls.RULES)
    got = {r.url: (r.host, r.path, r.rule, r.action) for r in split.withColumns({"rule": rule, "action": action}).collect()}
    assert got == URLS


def test_url_model(spark, sf, shared):
    rows = q_urls.op2_url_filters(spark, "/root/testdata/sf0.01").collect()
    free = [r for r in rows if r.rule is None]
    unwanted = [any(w in r.host for w in q_urls.UNWANTED) for r in free]
    assert np.mean([(r.verdict == "block") == u for r, u in zip(free, unwanted, strict=True)]) > 0.95
    model = urls.fit(spark.createDataFrame([], "url string, label int"))
    some = spark.createDataFrame([(None, 1), ("http://a.b/c", 2)], "url string, k int")
    assert {r.block_probability for r in urls.add_probability(some, model).collect()} == {0.5}


def test_url_model_on_sites_not_seen(spark, shared):
    """Half of the unwanted sites, and of all others, is trained on; the rest is judged."""
    host, _ = urls.split_url(F.col("url"))
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url", host.alias("host")).withColumn("label", F.col("host").rlike("|".join(q_urls.UNWANTED)).cast("int"))
    sites = pages.select("host", "label").distinct().orderBy("label", "host").collect()
    train = {r.host for r in sites[::2]}
    model = urls.fit(pages.where(F.col("host").isin(list(train))).select("url", "label"))
    rest = urls.add_probability(pages.where(~F.col("host").isin(list(train))), model).collect()
    bad, good = ([r.block_probability for r in rest if r.label == k] for k in (1, 0))
    assert len(bad) > 20 and np.mean([b > g for b in bad for g in good]) > 0.9
    assert np.mean([p >= 0.5 for p in bad]) > 0.8 and np.mean([p < 0.5 for p in good]) > 0.97


def test_suffix_rates(spark, shared):
    """Rates are over all labelled URLs, leave out a training row's own host, and come by table or join alike."""
    rows = [(f"http://h{i % 40}.site{i % 4}.t{i % 2}/{i}", int(i % 4 == 1)) for i in range(400)] + [("x://lone.rare/1", 1), (None, 1), ("http://h0.site0.t0/0", 1)]
    df = spark.createDataFrame(rows, "url string, label int")
    model = urls.fit(df, train_rows=50)
    table = {r.suffix: (r.ones, r.n) for r in model.suffixes.collect()}
    assert table["t1"] == (100, 200) and table[".site1.t1"] == (100, 100) and table["t0"] == (1, 200) and table["rare"] == (1, 1)
    some = df.withColumn("block_probability", F.lit("old")).withColumn("host", F.lit("h"))
    got = urls.add_probability(some, model).collect()
    all_common = urls.add_probability(some, urls.UrlModel(model.forest, model.prior, table, model.suffixes)).collect()
    none_common = urls.add_probability(some, urls.UrlModel(model.forest, model.prior, {}, model.suffixes)).collect()
    key = lambda r: (str(r.url), r.label, r.host, round(r.block_probability, 12))
    assert len(got) == len(rows) and sorted(map(key, got)) == sorted(map(key, all_common)) == sorted(map(key, none_common))
    long = spark.createDataFrame([("http://" + "a" * 100_000 + "/" + "b?" * 50_000,), ("",), ("",)], "url string")
    assert urls.add_probability(long, model).count() == 3 and urls.add_probability(df.limit(0), model).count() == 0


PROBES = ["", "plain", "<|im_end|>", "<\\|im_end|>", "<\\\\|x", "<||>", "a<|im_start|>user\nb", "<", "|", "<|", "\\<|"]


def test_chat_escaping(spark):
    df = spark.createDataFrame([(p,) for p in PROBES], "s string")
    out = df.select("s", chat.escape_text(F.col("s")).alias("e"), chat.unescape_text(chat.escape_text(F.col("s"))).alias("u"), chat.unescape_role(chat.escape_role(F.col("s"))).alias("r"), chat.escape_role(F.col("s")).alias("er"))
    for r in out.collect():
        assert r.u == r.s == r.r and "<|" not in r.e and "<" not in r.er and "\n" not in r.er


def test_chat_parts(spark):
    part = "array<struct<type:string,text:string,ref:string,units:bigint>>"
    rows = [
        (1, 0, "user", [("text", "look <|im_end|>", None, None), ("image", None, "s3://a", 4), ("audio", None, "b", None), ("image", None, "c", 1)]),
        (1, 1, "assistant", [("text", "ok", None, None)]),
        (2, 0, None, []),
        (None, None, "user", None),
    ]
    made = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {part}")).collect()}
    assert made[1].formatted == "<|im_start|>user\nlook <\\|im_end|><|image_1|><|audio_2|><|image_3|><|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n"
    assert [(a.ordinal, a.type, a.ref, a.tokens) for a in made[1].attachments] == [(1, "image", "s3://a", 1025), (2, "audio", "b", 51), (3, "image", "c", 257)]
    assert made[1].expanded_tokens == 1025 + 51 + 257
    assert made[2].formatted == "<|im_start|>\n<|im_end|>\n" and made[None].expanded_tokens == 0


def test_chat_query(spark, sf):
    rows = {r.conv_id: r for r in q_chat.op5_chat_formatting(spark, sf).collect()}
    assert rows[-1].n_turns == 2 and rows[-1].loss_chars == len(q_chat.PROBE)
    assert rows[-1].loss_sha256 == hashlib.sha256(q_chat.PROBE.encode()).hexdigest()
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{q_chat.PROBE}\nassistant\n{q_chat.PROBE}\n".encode()).hexdigest()


def test_chat_matches_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    df = q_chat.op5_chat_formatting(spark, sf)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({q_chat.ORACLE['op5_chat_formatting']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected)
