"""The registered leaderboards train the whole zoo, not a part of it."""

import pytest

from tabwise.operators.ml import train
from tabwise.operators.ml.zoo import default_models
from tabwise.plans.catalog import ml_q


class Seen(Exception):
    pass


@pytest.fixture()
def tables(spark, tmp_path):
    """A few orders, customers, line items and parts."""
    spark.sql("""select id as o_orderkey, id % 10 as o_custkey, 'O' as o_orderstatus, id * 7919 % 400000 + 0.5d as o_totalprice,
        timestamp '1995-01-01' + make_interval(0, 0, 0, cast(id as int)) as o_orderdate,
        concat(id % 5 + 1, '-P') as o_orderpriority from range(60)""").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql("""select id as c_custkey, concat('C', id) as c_name, cast(id as int) as c_nationkey, id * 31.5d as c_acctbal,
        concat('S', id % 3) as c_mktsegment from range(10)""").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql("""select id as l_orderkey, id % 7 as l_partkey, id % 3 as l_suppkey, cast(1 as int) as l_linenumber,
        cast(id % 50 + 1 as double) as l_quantity, id % 11 / 100d as l_discount, id % 9 / 100d as l_tax,
        case when id % 2 = 0 then 'N' else 'R' end as l_returnflag from range(60)""").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("select id as p_partkey, cast(id % 50 as int) as p_size, 900 + id * 1.5d as p_retailprice from range(7)").write.parquet(
        f"{tmp_path}/part.parquet")
    return str(tmp_path)


@pytest.mark.parametrize(("query", "task", "more"), [
    (ml_q.q_cv, "classification", {"Naive Bayes", "Decision Tree"}), (ml_q.q_test, "classification", {"Naive Bayes", "Decision Tree"}),
    (ml_q.q_summary, "classification", {"Naive Bayes", "Decision Tree"}), (ml_q.q_regression, "regression", {"Decision Tree"})])
def test_leaderboards_train_the_whole_zoo(spark, tables, monkeypatch, query, task, more):
    def seen(data, kind, models, *a, **b):
        assert kind == task and set(models) == set(default_models(task)) | more
        assert data.count() in (47, 48)  # 60 rows without the held-out fifth of every class
        raise Seen
    monkeypatch.setattr(train, "train_all", seen)
    with pytest.raises(Seen):
        query(spark, tables)


@pytest.mark.parametrize("name", ["Logistic Regression", "Naive Bayes", "Decision Tree"])
def test_models_taken_by_name_come_from_the_shared_run_if_it_is_there(spark, monkeypatch, name):
    monkeypatch.setitem(ml_q._RUNS, (id(spark), "somewhere"), name)
    assert ml_q._model_run(spark, "somewhere") == name


def test_training_reads_neither_the_tables_nor_the_texts_again(spark, tables, monkeypatch):
    from tabwise.plans.testviews import document_table

    def seen(data, *a, **b):
        assert not [f for f in data.inputFiles() if f.startswith(f"file:{tables}") or f.startswith(f"file://{tables}")]
        raise Seen
    monkeypatch.setattr(train, "train_all", seen)
    with pytest.raises(Seen):
        ml_q.q_test(spark, tables)
    spark.sql("select id as doc_id, concat('Text ', id, '.') as text, 'en' as lang, 's' as source, 7L as n_chars from range(9)").write.parquet(
        f"{tables}/documents.parquet")
    spark.sql("select id as doc_id, cast(id % 2 as int) as quality from range(6)").write.parquet(f"{tables}/labels.parquet")
    docs = document_table(spark, tables)
    assert docs.count() == 6 and not [f for f in docs.inputFiles() if tables in f]
