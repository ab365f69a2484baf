"""Properties from the test strategy: samplers keep their exclusions, flatten → regroup is the identity,
batch plans use each row at most once with full batches."""

from conftest import SF001
from pyspark.sql import functions as F

from pairloom.operators import batches as B
from pairloom.operators import ordering as O
from pairloom.operators import pairs as P
from pairloom.operators import triplets as TR
from pairloom.plans.fixtures import Tables, triplets


def test_label_negatives_respect_exclusions(spark):
    t = Tables(spark, SF001)
    out = TR.triplets_by_label(t.documents, "doc_id", "text", "lang", num_negs=7, seed=11)
    valid = TR.clean_valid(t.documents.select("doc_id", F.col("text").alias("_raw"), "lang"), "_raw")
    lab = valid.select(F.col("text").alias("neg_text"), F.col("lang").alias("neg_label"))
    ex = out.select("doc_id", "anc", "pos", "label", F.explode("neg").alias("neg_text"))
    assert ex.filter((F.col("neg_text") == F.col("anc")) | (F.col("neg_text") == F.col("pos"))).count() == 0
    # every negative text occurs in some other label's pool
    other = ex.join(lab, "neg_text").filter(F.col("neg_label") != F.col("label")).select("doc_id", "neg_text").distinct()
    assert other.count() == ex.select("doc_id", "neg_text").distinct().count()
    assert out.filter(F.size("neg") != 7).count() == 0


def test_flatten_regroup_is_identity(spark):
    t = Tables(spark, SF001)
    trip = triplets(t).select("anc", "pos", F.filter("neg", lambda x: x.isNotNull()).alias("neg"), "label", "subset", "id")
    back = P.regroup_triplets(O.dense_index(P.flatten_triplets(trip)))
    a = trip.select("subset", "id", "anc", "pos", "neg", "label")
    b = back.select("subset", "id", "anc", "pos", "neg", "label")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_batch_plans_use_rows_at_most_once(spark):
    t = Tables(spark, SF001)
    tr = triplets(t).select("subset", "id", "label", F.size(F.filter("neg", lambda x: x.isNotNull())).alias("neg_len"))
    fixed = B.batch_plan(tr, ["subset", "id"], per_rank=4, world=2, seed=3, label_group_subsets=["src1"])
    assert fixed.groupBy("subset", "id").count().filter(F.col("count") > 1).count() == 0
    assert fixed.groupBy("batch_id").count().filter(F.col("count") != 8).count() == 0
    ids = [r.batch_id for r in fixed.select("batch_id").distinct().collect()]
    assert sorted(ids) == list(range(len(ids)))
    dyn = B.batch_plan_dynamic(tr, ["subset", "id"], per_rank=4, world=2, max_pairs=6, seed=3, block_rows=7)
    assert dyn.groupBy("subset", "id").count().filter(F.col("count") > 1).count() == 0
    per_batch = dyn.groupBy("batch_id", "task").agg(F.count(F.lit(1)).alias("n"))
    assert per_batch.filter(~F.col("n").isin(2, 4, 6, 8)).count() == 0
