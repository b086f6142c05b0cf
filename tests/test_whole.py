"""Queries over their whole tables."""

import re

import pytest
from pyspark.sql import functions as F

from tempotrail.functions import text as tx
from tempotrail.plans.proxy import Model
from tempotrail.plans.replay import anchors
from tempotrail.registry import QUERIES

#: More results than any id that queries were once cut at.
FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "times"), [("rp_time_at", 2), ("rp_dist_at", 2), ("rp_state", 1)])
def test_every_result_is_replayed(spark, name, times):
    assert QUERIES[name](spark, FOLDER).count() == times * Model(spark, FOLDER).results.count() > times * 3000


def test_every_runner_has_a_rank(spark):
    ranks = QUERIES["rp_map_state"](spark, FOLDER)
    runners = anchors(Model(spark, FOLDER)).select("result_id").distinct()
    assert ranks.count() == runners.count() > 3000 and ranks.select("result_id").exceptAll(runners).isEmpty()


def test_every_result_is_joined(spark):
    model = Model(spark, FOLDER)
    assert QUERIES["jn_nearest_anchor"](spark, FOLDER).count() == 3 * model.results.count() > 3 * 4000
    assert QUERIES["jn_index"](spark, FOLDER).count() == model.splits.count()


def test_every_text_is_normalised_whole(spark, tmp_path):
    texts = [(1, None), (2, "Привет ABC"), (3, "Ab-Çd " * 200), (4, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["norm"] for r in QUERIES["fn_normalize"](spark, str(tmp_path)).collect()}
    assert found == {1: "", 2: "abc", 3: " ".join(["ab cd"] * 200), 4: ""}


def test_every_character_is_normalised(spark):
    """Each character between two letters, against the rule in Python; marks, ligatures and full-width letters too."""
    chars = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    texts = [(i, "".join(f"a{c}b " for c in chars[i : i + 512])) for i in range(0, len(chars), 512)] + [(-1, "Šimůnek Žiga Erdős Čapek ﬁnal Ｆｕｌｌ ½ Ⅷ – x"), (-2, "e\u0301a\u20ddb")]
    rows = spark.createDataFrame(texts, "id long, text string").select("id", tx.normalised(F.col("text")).alias("norm"))
    found = {r["id"]: r["norm"] for r in rows.collect()}
    assert found == {i: re.sub("[^a-z0-9]+", " ", tx.plain(t).lower()).strip() for i, t in texts}
    assert found[-1] == "simunek ziga erdos capek final full 1 2 viii x"
