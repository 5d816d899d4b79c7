"""Every registered query against its oracle, and the shape of the plans."""

import os
import re

import pytest

import oracle
from postlift.plans import catalog

SF = "/root/testdata/sf0.001"

# Python on workers is limited to dense scoring and model fits.
PYTHON_ALLOWED = {"q_late_fusion_mlp", "q_ablation_mlp", "q_permutation_mlp"}



@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    assert oracle.compare(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name]) is None


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


PLANNED = ("q_asset_gate", "q_compose", "q_cohort_label", "q_cohort_threshold", "q_global_label",
           "q_incremental_anti", "q_label_table", "q_lag_range_join", "q_roc_auc",
           "q_supervised_matrix", "q_tabular_vector", "q_text_template", "q_time_folds")


@pytest.mark.parametrize("name", PLANNED)
def test_plans_stay_in_the_jvm_without_cross_joins(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroups", plan)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_matrix_needs_one_shuffle_beyond_the_panel(spark):
    from postlift.operators.temporal import supervised_matrix
    from postlift.plans import fixtures
    from postlift.session import materialize
    panel = materialize(fixtures.panel(spark, SF), "panel")
    plan = supervised_matrix(panel, "entity", "month", "label", ["n_orders"], 3, 12)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_scan_reads_only_the_columns_it_needs(spark):
    df = catalog.QUERIES["q_scan_profile"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_entry_points(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_names_faults_of_the_optional_package(tmp_path):
    """Where the package is absent the rest is registered; a broken import inside it is raised."""
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    shutil.copytree(os.path.join(root, "postlift"), tmp_path / "postlift",
                    ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    count = "import __spark_entry__ as e; print(len(e.queries()))"

    def run():
        return subprocess.run([sys.executable, "-c", count], cwd=tmp_path, capture_output=True, text=True, timeout=120)

    assert int(run().stdout.split()[-1]) == len(catalog.QUERIES)
    (tmp_path / "corpus_pipeline.py").write_text("import postlift.llm.queries")
    (tmp_path / "postlift" / "llm").mkdir()
    (tmp_path / "postlift" / "llm" / "__init__.py").write_text("")
    (tmp_path / "postlift" / "llm" / "queries.py").write_text("import no_such_module")
    assert "no_such_module" in run().stderr


def test_labelled_rows_are_composed_once(spark, monkeypatch):
    """The media and the rows that they are attached to read stored rows, which no join makes again."""
    from postlift.plans import clean_queries
    written, write = [], clean_queries.sinks.write_shards
    monkeypatch.setattr(clean_queries.sinks, "write_shards",
                        lambda df, path: (written.append(df), write(df, path)))
    catalog.QUERIES["q_build_labelled"](spark, SF)
    plan = written[0]._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and plan.count("Join") == 2
    assert "REPARTITION_BY_COL" in plan  # by id, ahead of the bytes
    assert "ShuffledHashJoin" in plan and "Sort [" not in plan  # no task sorts the bytes


def scratch_tables(spark):
    from postlift.session import scratch_root
    root = scratch_root(spark).removeprefix("file:")
    return {f"{root}/{n}" for n in os.listdir(root) if re.search(r"-[0-9a-f]{32}$", n)} if os.path.isdir(root) else set()


def test_labelled_dataset_is_what_stays_on_disk(spark, monkeypatch):
    """Rows that led to the kept ones are gone when the bytes are written, and the kept ones afterwards; shuffle
    files go with their steps, and the bytes lie packed."""
    import glob
    import pyarrow.parquet as pq
    from postlift.plans import clean_queries
    local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0]
    shuffled = lambda: set(glob.glob(f"{local}/**/shuffle_*.data", recursive=True))
    tables, before, seen, write = scratch_tables(spark), shuffled(), [], clean_queries.sinks.write_shards

    def made():
        return sorted(os.path.basename(t).rsplit("-", 1)[0] for t in scratch_tables(spark) - tables)

    def watched(df, path):
        seen.append((made(), shuffled() - before))
        return write(df, path)

    monkeypatch.setattr(clean_queries.sinks, "write_shards", watched)
    labelled = catalog.QUERIES["q_build_labelled"](spark, SF)
    assert seen == [(["kept"], set())]
    assert made() == ["dataset"] and not shuffled() - before
    files = glob.glob(f"{(scratch_tables(spark) - tables).pop()}/data/*/*.parquet")
    columns = {c["path_in_schema"]: c["compression"] for f in files for g in pq.read_metadata(f).to_dict()["row_groups"]
               for c in g["columns"]}
    assert columns["video_bytes"] == "ZSTD" and len(columns) > 50
    assert labelled.where("n_bytes > 0").count() == labelled.count() > 0


@pytest.mark.parametrize("few_posts, moved", [(0, ["_page"]), (1 << 20, ["id"])])
def test_bytes_of_a_large_media_table_move_once(spark, duck, monkeypatch, few_posts, moved):
    from postlift.operators import compose
    from postlift.plans import clean_queries
    plans, write = [], clean_queries.sinks.write_shards

    def watched(df, path):
        plans.append(df._jdf.queryExecution().executedPlan())
        return write(df, path)

    monkeypatch.setattr(clean_queries.sinks, "write_shards", watched)
    monkeypatch.setattr(compose, "FEW_BYTES", 0, raising=False)
    monkeypatch.setattr(compose, "FEW_POSTS", few_posts, raising=False)
    wide, threshold = [], "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(threshold, "-1")
    try:
        found = catalog.QUERIES["q_build_labelled"](spark, SF)
        assert oracle.compare(found, duck, catalog.ORACLES["q_build_labelled"]) is None
    finally:
        spark.conf.unset(threshold)
    nodes = [plans[0].initialPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        output = node.output().mkString(" ")
        if "ShuffleExchange" in node.getClass().getName() and re.search(r"video_bytes|html", output):
            wide.append(re.search(r"hashpartitioning\((\w+)#", node.toString()).group(1))
    assert wide == moved


def test_media_are_found_whole_in_every_way(spark, monkeypatch):
    """Repeated keys, keys without media and media without bytes, however large tables are taken to be."""
    from postlift.operators import compose
    from postlift.session import TOGETHER, holding
    posts = spark.createDataFrame([(i, i % 7 if i % 5 else None) for i in range(200)], "id long, k long")
    store = spark.createDataFrame([(k, None if k == 3 else bytes([k]) * k) for k in range(6)], "k long, video_bytes binary")
    want = sorted((i, None if i % 5 == 0 or i % 7 in (3, 6) else bytes([i % 7]) * (i % 7)) for i in range(200))
    for few_bytes, few_posts in ((1 << 20, 1), (0, 1 << 20), (0, 0)):
        monkeypatch.setattr(compose, "FEW_BYTES", few_bytes)
        monkeypatch.setattr(compose, "FEW_POSTS", few_posts)
        media = compose.find_media(posts, store, "k")
        by = tuple(c for c in ("id", "k") if c in media.columns)
        with holding(spark, TOGETHER):
            found = compose.attach_media(posts, media, by).collect()
        assert sorted((r.id, r.video_bytes and bytes(r.video_bytes)) if r.video_bytes is not None else (r.id, None)
                      for r in found) == want
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
