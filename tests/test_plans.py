"""Plans of queries: what is costly stands in them once, and nothing large is written."""

import pytest

from sluier.plans import registry

DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["n3_drop_subsumed_spans", "n5_merge_name_spans", "n6_coalesce_names", "l6_supplement_names", "d4_detect_bsn", "d14_detect_context_dates", "g7_generalise_all", "v12_respan_and_annotate", "n10_merge_window_spans"])
def test_spans_are_not_found_again_by_a_filter(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    found = plan(registry.queries()[name](spark, DIR))
    assert not [line for line in found.splitlines() if "Filter" in line and ("regexp" in line or "split" in line)]


def test_dossiers_are_not_written(spark):
    from sluier.plans.dossiers import gold

    assert all(f.endswith("orders.parquet") for f in gold(spark, DIR).inputFiles())


@pytest.mark.parametrize("name", ["e1_match_exact", "e8_confusion_matrix", "e20_report_document", "v6_pseudonymise_text", "v7_dry_run"])
def test_labels_and_finds_are_not_gathered_by_document_and_type(spark, name):
    found = plan(registry.queries()[name](spark, DIR))
    assert not [line for line in found.splitlines() if "Aggregate [doc_id" in line and "collect_list" in line]


def test_vault_shuffles_no_pseudonyms(spark):
    found = plan(registry.queries()["v5_build_mappings"](spark, DIR)).splitlines()
    aggregated = next(line for line in found if "Aggregate [session_id" in line)
    assert "pseudonym" not in aggregated and "entity_category" not in aggregated


def test_labelled_lines_are_compressed(spark, tmp_path):
    from sluier.sources.tables import read_labelled_jsonl, write_labelled_jsonl

    path = str(tmp_path / "lines")
    write_labelled_jsonl(spark.sql("SELECT '1' AS id, 'Jan, Jan' AS prompt, array(named_struct('start', 0, 'end', 3, 'text', 'Jan', 'type', 'name', 'category', 'c', 'note', '')) AS entities"), path)
    assert list((tmp_path / "lines").glob("*.json.gz")) and not list((tmp_path / "lines").glob("*.json"))
    assert read_labelled_jsonl(spark, path)[0].select("id", "prompt").collect() == [("1", "Jan, Jan")]
