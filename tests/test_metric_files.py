"""JSON of unknown shape, by leaf."""

from hindcast.operators.metrics import leaderboard
from hindcast.sources.io import flatten_json, read_metrics


def test_leaves_of_any_shape(spark):
    docs = [(1, '{"a": {"b": [1, {"c": "x"}], "n": null}, "roi": "1.5"}'), (2, "[2.5, [3]]"), (3, "no json"), (4, "7"), (5, "{}"), (6, None)]
    got = flatten_json(spark.createDataFrame(docs, "k int, doc string"), ["k"], "doc").collect()
    assert sorted((r["k"], r["path"], r["number"]) for r in got if r["number"] is not None) == [(1, "a.b[0]", 1.0), (1, "roi", 1.5), (2, "[0]", 2.5), (2, "[1][0]", 3.0), (4, "", 7.0)]
    assert sorted((r["k"], r["path"], r["text"]) for r in got if r["number"] is None) == [(1, "a.b[1].c", "x"), (1, "a.n", None), (3, "", None), (6, "", None)]


def test_leaderboard_over_files(spark, tmp_path):
    for name, text in (("x", '{"roi": 0.9}'), ("y", '{\n "m": {"return": 1.1},\n "n": 4}'), ("z", '{"m": {}}'), ("w", "broken {")):
        (tmp_path / f"e={name}").mkdir()
        (tmp_path / f"e={name}" / "metrics.json").write_text(text)
    out = leaderboard(read_metrics(spark, str(tmp_path), "e"), "e", {"roi": ["roi", "m.return"], "n": ["n"]}, "roi").collect()
    assert sorted((r["place"], r["e"], r["roi"], r["n"]) for r in out)[:2] == [(1, "y", 1.1, 4.0), (2, "x", 0.9, None)]
    assert {r["e"] for r in out} == {"x", "y", "w"}
