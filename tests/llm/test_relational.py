import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from rillflow.llm import mixing, quality, sharding, url_filter
from rillflow.llm.queries import ORACLES, QUERIES

from tests.llm.helpers import CLASHES, awkward, awkward_rows, empty, prose, words
from tests.oracle import compare, database

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), database(SF_DIR), ORACLES[name]) == ""


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_reaches_its_targets(spark):
    out = mixing.copies(awkward(spark), payload=["source"]).select("*", "payload.source").collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, text, _, source, _ in awkward_rows():
        sizes[source] += len(words(text))
        largest[source] = max(largest[source], len(words(text)))
    target = brute_targets(sizes)
    assert len(out) == len(awkward_rows())
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1
    mixed = mixing.mix_documents(awkward(spark))
    assert mixed.columns == awkward(spark).columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.copies(empty(spark)).count() == 0 and mixing.mix_documents(empty(spark)).count() == 0


def test_rows_tied_at_the_border_only_fill_the_gap(spark, tmp_path):
    rows = [(1, prose(3, 40), "en", "a", 0)] * 200 + [(1000 + i, prose(i, 30), "en", "b", 0) for i in range(50)]
    rows += [(None, prose(4, 25), "en", "c", 0)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents"))
    df = spark.read.parquet(str(tmp_path / "documents"))
    out = mixing.copies(df).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    assert compare(out, con, ORACLES["op2_mix_sources"]) == ""
    for size, (taken, target) in {r["size"]: (r["sum(taken)"], r["max(target)"]) for r in out.filter("size > 0").groupBy("size").agg({"taken": "sum", "target": "max"}).collect()}.items():
        assert abs(taken - target) <= size / 2 + 1


def test_inclusion_follows_the_odds(spark):
    """Over many seeds short documents enter more rarely than long ones, by their odds."""
    rows = [(i, " ".join(["w"] * (4 if i % 2 else 64)), "en", "a", 0) for i in range(400)]
    rows += [(1000 + i, " ".join(["w"] * 50), "en", "b", 0) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.copies(df).filter("size in (4, 64)").groupBy("size").avg("copies").collect()
    short, long = (next(r[1] for r in got if r[0] == k) for k in (4, 64))
    ratio = next(iter({r["target"] / r["source_size"] for r in mixing.copies(df).filter("size = 4").collect()}))
    assert int(ratio) <= short < long <= int(ratio) + 1


def test_shards_are_a_permutation(spark):
    df = awkward(spark)
    one = {(r["shard"], r["slot"]): r for r in sharding.shard(df, 7, 7, 20_000).collect()}
    again = {(r["shard"], r["slot"]): r["record"]["doc_id"] for r in sharding.shard(df.repartition(5), 7, 7, 20_000).collect()}
    other = {(r["shard"], r["slot"]): r["record"]["doc_id"] for r in sharding.shard(df, 7, 8, 20_000).collect()}
    assert {k: r["record"]["doc_id"] for k, r in one.items()} == again != other
    assert len(one) == len(awkward_rows())
    slots = defaultdict(list)
    for shard, slot in one:
        slots[shard].append(slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    for r in one.values():
        raw = (r["record"]["text"] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    assert sorted(repr((r["record"]["doc_id"], r["record"]["text"])) for r in one.values()) == sorted(repr(r[:2]) for r in awkward_rows())
    assert sharding.shard(empty(spark)).count() == 0


def test_written_shards_read_back(spark):
    df = awkward(spark).withColumn("tags", F.create_map(F.lit("k"), F.col("source")))
    path = sharding.write_shards(df, None, 5, 7, 20_000)
    back = sharding.read_shards(spark, path, df).collect()
    straight = sharding.shard(df, 5, 7, 20_000).collect()
    seen = lambda rows: sorted((r["shard"], r["slot"], r["size"], r["text_crc32"], repr(r["record"]["doc_id"]), repr(r["record"]["text"])) for r in rows)
    assert seen(back) == seen(straight) and len(back) == len(awkward_rows())
    assert all(r["record"]["tags"] == {"k": r["record"]["source"]} for r in back)
    counts = Counter(r["shard"] for r in back)
    assert set(counts) == set(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in back) == [(s, k) for s in range(5) for k in range(counts[s])]
    nothing = empty(spark)
    assert sharding.read_shards(spark, sharding.write_shards(nothing), nothing).count() == 0


def test_few_rows_fill_the_first_shards_evenly(spark):
    df = spark.createDataFrame([(i, f"t{i}", "en", "a", 0) for i in range(7)], "doc_id long, text string, lang string, source string, n_chars long")
    out = sharding.shard(df, 40).collect()
    assert len({r["shard"] for r in out}) == 7 and {r["slot"] for r in out} == {0} and all(0 <= r["shard"] < 40 for r in out)


def brute_counts(text):
    ws, text = words(text), text or ""
    seen, covered = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7)), set()
    for i in range(len(ws) - 7):
        if seen[tuple(ws[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if words(x)]
    failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_counts_equal_brute_force(spark):
    rows = [*awkward_rows(), (500, "a b c d e f g h " * 6 + prose(9, 200), "en", "a", 0), (501, " ".join(f"{i}#" for i in range(60)), "en", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = quality.judged(df).collect()
    assert sorted(repr((r["doc_id"], tuple(r["_rule"]))) for r in out) == sorted(repr((r[0], brute_counts(r[1]))) for r in rows)
    assert not any(r["_rule_kept"] for r in out if r["_rule"]["base_failed"])
    kept = quality.filter_documents(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert quality.filter_documents(empty(spark)).count() == 0


def test_divergence_rejects_odd_text_and_keeps_prose(spark):
    rows = [(i, prose(i, 150), "en", "a", 0) for i in range(60)]
    rows += [(100, " ".join(f"{i * 37 % 91}$%&{i}" for i in range(150)), "en", "a", 0), (101, prose(200, 150), "zz", "a", 0), (102, prose(201, 150), None, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in quality.filter_documents(df).select("doc_id").collect()}
    assert kept == {r[0] for r in rows} - {100}


ENGLISH = """The house at the end of the road was built by a farmer in the last years of the war, and it is still the largest that
stands on the hill. From the windows you can look over the fields to the river, which is deep and slow in summer but rises to the
bridge after heavy rain. In those days there were no shops or schools for miles, so the children walked with their father to the
next village and came home in the evening with bread, salt and oil. It is said that he planted every tree on this land with his own
hands, and that the oldest of them are as old as the house. Now the place is to be sold, and nobody knows if the new owners will keep
the orchard or cut it down for a garden. We hope that it will be left as it was."""


def english(seed: int) -> str:
    """A real passage with its words in another order."""
    return " ".join(w for _, w in sorted((zlib.crc32(f"{seed}:{i}".encode()), w) for i, w in enumerate(ENGLISH.split())))


def test_no_mark_and_no_table_size_decides(spark):
    """Junk is rejected and prose kept under any mark, in a table of three rows as in one of thousands."""
    junk = " ".join(f"{i * 37 % 91}$%&{i}" for i in range(150))
    odd = " ".join(f"qx{i * 7919 % 9973}z" for i in range(200))
    marks = ["en", "de", "it", "zz", None]
    few = [(i, t, m, "a", 0) for m in marks for i, t in enumerate((junk, odd, english(0)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    many = few + [(10 + i, english(i), "en", "a", 0) for i in range(2000)]
    for rows in (few[:3], few[-3:], few, many):
        out = quality.judged(spark.createDataFrame(rows, schema)).filter("doc_id < 10").collect()
        assert {(r["doc_id"], r["_rule_kept"]) for r in out} == {(0, False), (1, False), (2, True)}


def test_references_count_and_shrink(spark):
    rows = [(1, "the the of x " * 500, "en", "a", 0), (2, "the the of x " * 500, None, "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    refs = {r["lang"]: r for r in quality.references(quality.profiled(df, ["doc_id"]))}
    prior = quality.prior_shares(quality.FUNCTION_WORDS["en"])
    assert refs["en"]["words"]["the"] == pytest.approx((2000 * prior["the"] + 1000) / 4000)
    assert refs["en"]["words"]["or"] == pytest.approx(prior["or"] / 2)
    assert refs["de"]["words"] == pytest.approx(quality.prior_shares(quality.FUNCTION_WORDS["de"]))
    assert all(sum(r["classes"]) == pytest.approx(1.0) for r in refs.values()) and len(refs) == len(quality.FUNCTION_WORDS)


def test_another_language_needs_its_words(spark):
    own = "joka oli ja se hän että mutta kun niin".split()
    text = " ".join(f"sana{i}" if i % 3 else own[i // 3 % 9] for i in range(150))
    df = spark.createDataFrame([(1, text, "fi", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert not quality.judged(df).first()["_rule_kept"]
    assert quality.judged(df, function_words=quality.FUNCTION_WORDS | {"fi": own}).first()["_rule_kept"]


def test_most_labelled_junk_is_rejected_and_clean_text_is_kept(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = quality.judged(docs, ["doc_id"]).filter("not _rule.base_failed").join(labels, "doc_id").select("quality", "_rule_kept").collect()
    kept = {k: [r["_rule_kept"] for r in out if r["quality"] == k] for k in (0, 1)}
    assert sum(kept[0]) / len(kept[0]) < 0.2 and sum(kept[1]) / len(kept[1]) > 0.999


def test_url_rules_and_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com/en/", "http://a.example.com/en/", "http://example.com",
            "http://net/es/", "http://xnet/es/", "http://a.net/fr/1#u", "s://É.com/", "http://h?://q/", "a://b\nc/d"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(1, None), (None, "http://org/x")], "page_id long, url string")
    outcomes = spark.createDataFrame([(0, 1), (None, 1), (4, None)], "page_id long, good int")
    out = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in url_filter.judge(pages, outcomes).collect()}
    assert out[(4, "www.example.com", "/en/x")] == ("www.example.com/en/", "allow")
    assert out[(6, "a.example.com", "/en/")] == ("example.com/en/", "block")
    assert out[(7, "example.com", "")] == (None, "allow")
    assert out[(8, "net", "/es/")] == ("net/es/", "block") and out[(9, "xnet", "/es/")][0] is None
    assert out[(11, "É.com", "/")] == ("com/", "allow") and (12, "h", "") in out and (13, "b\nc", "/d") in out
    assert (0, "", "") in out and (3, "", "") in out and len(out) == 15
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, outcomes).count() == 0


def test_bad_hosts_are_blocked_and_unknown_ones_inherit(spark):
    urls = [f"http://h{i % 10}.good.org/{i}" for i in range(400)] + [f"http://h{i % 10}.bad.org/{i}" for i in range(400)] + ["http://new.bad.org/", "http://new.good.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int((i < 400) != (i % 17 == 0))) for i in range(800)], "page_id long, good int")
    out = {r["host"]: r["verdict"] for r in url_filter.judge(pages, outcomes).collect()}
    assert all(v == ("block" if "bad" in h else "allow") for h, v in out.items() if not h.startswith("new"))
    assert out["new.good.org"] == "allow"


def test_blocked_hosts_equal_sql_and_the_plan_stays_small(spark, tmp_path):
    """Planted bad hosts, unlabelled and repeated pages, NULL ids: the method's verdicts equal the SQL's."""
    urls = [f"http://h{i % 9}.{'bad' if i % 3 == 0 else 'good'}{i % 5}.{('org', 'co.uk', 'info')[i % 7 % 3]}/{i}" for i in range(3000)]
    pages = [(i, u) for i, u in enumerate(urls)] + [(5, urls[8]), (None, urls[0]), (None, "http://only.null.org/"), (3001, None)]
    spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "good", "n", "mean", "upper", "suffix")}).write.parquet(str(tmp_path / "pages.parquet"))
    labels = [(i, int((i % 3 == 0) == (i % 11 == 0)), i % 2 and None) for i in range(2400) if i % 4] + [(1, None, 1), (2, 0, 1), (2, 0, 1), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = QUERIES["op1_url_filter"](spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert compare(out, con, ORACLES["op1_url_filter"]) == ""
    verdicts = Counter((r["verdict"], "bad" in r["host"]) for r in out.filter("rule is null").collect())
    assert verdicts["block", True] > 500 and verdicts["block", False] == 0 and verdicts["allow", False] > 1500
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") < 30
