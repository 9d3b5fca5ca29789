from strandwork.operators import contracts as c

FORWARD = c.SearchProtocol("all", "evaluation-queries", "hits-v1")
REVERSE = c.SearchProtocol("all", "train-queries", "hits-v1", sources=("a", "b"), audit_tag="audit-v1")
TOPOLOGIES = {"fresh": {"all_splits": (FORWARD, REVERSE)}, "two": {"parent": (FORWARD,), "delta": (FORWARD, REVERSE)}}
GOOD = {"query_scope": "all", "search_orientation": "evaluation-queries", "normalized_hit_table_schema": "hits-v1", "sensitivity": 7.5, "maximum_evalue": 0.001, "configured_candidate_cap": 1_000_000, "maximum_emitted_hits_for_one_evaluation_query": 10, "all_emitted_hit_counts_below_cap": True}
SOURCE = {"reverse_recovers_every_forward_pair": True, "forward_only_pairs": 0, "sample_training_sequences": 9000}
AUDITED = {k: v for k, v in GOOD.items() if "emitted" not in k} | {"search_orientation": "train-queries", "evaluation_target_sequences": 5, "candidate_cap_unreachable": True, "orientation_audit": {"protocol": "audit-v1", "all_sources_reverse_recover_every_forward_pair": True, "minimum_sampled_training_sequences_per_source": 8192, "sources": {"a": SOURCE, "b": SOURCE}}}


def test_search_contracts():
    assert c.search_problems({"all_splits": GOOD}, TOPOLOGIES) == []
    assert c.search_problems({"all_splits": AUDITED}, TOPOLOGIES) == []
    assert c.search_problems({"parent": GOOD, "delta": AUDITED}, TOPOLOGIES) == []
    assert c.search_problems({"parent": AUDITED, "delta": GOOD}, TOPOLOGIES) == ["parent"]
    assert c.search_problems({"other": GOOD}, TOPOLOGIES) == ["topology"] and c.search_problems(None, TOPOLOGIES) == ["search_contracts"]
    for key, bad in (("sensitivity", 7.4), ("sensitivity", True), ("maximum_emitted_hits_for_one_evaluation_query", 1_000_000), ("all_emitted_hit_counts_below_cap", 1), ("maximum_evalue", 0.01)):
        assert c.search_problems({"all_splits": GOOD | {key: bad}}, TOPOLOGIES) == ["all_splits"], key
    worse = AUDITED | {"orientation_audit": AUDITED["orientation_audit"] | {"sources": {"a": SOURCE, "b": SOURCE | {"forward_only_pairs": 1}}}}
    assert c.search_problems({"all_splits": worse}, TOPOLOGIES) == ["all_splits"]


def test_resume():
    stage = {"name": "stage1", "context_length": 512, "micro_batch_size": 64, "gradient_accumulation": 4, "mixture": {"a": 1.0}}
    saved = {"stages": [stage], "max_steps": 100, "optimizer": "x"}
    ok = {"stages": [stage | {"micro_batch_size": 32}], "max_steps": 200, "optimizer": "x"}
    assert c.resume_problems(saved, ok, 4, 8, 100, 5) == []
    assert c.resume_problems(saved, ok, 4, 4, 100, 5) == ["stages.0.global_batch"]
    assert c.resume_problems(saved, ok | {"optimizer": "y"}, 4, 8, 100, 5) == ["optimizer"]
    assert c.resume_problems(saved, ok | {"max_steps": 100}, 4, 8, 100, 5) == ["max_steps"]
    assert c.resume_problems(saved, {k: v for k, v in ok.items() if k != "max_steps"}, 4, 8, 1, 5) == ["endpoint"]
    assert c.resume_problems(saved, ok | {"stage1_cooldown_fraction": 0.2}, 4, 8, 1, 5) == ["stage1_cooldown_fraction", "schedule"]
    assert "stages" in c.resume_problems(saved, ok | {"stages": ok["stages"] * 2}, 4, 8, 1, 5)


def test_steps_rates_paths():
    assert c.stage_steps(100, 1, consumed=30) == [70] and c.stage_steps(100, 2) == [67, 33] and c.stage_steps(100, 2, consumed=80) == [0, 20]
    rate, decay = c.transfer_rates(1024, 64)
    assert abs(rate - 1.5e-4) < 1e-12 and abs(decay - 0.04) < 1e-9
    assert c.safe_path("a/b.parquet") and not c.safe_path("/a") and not c.safe_path("a/../b") and not c.digest("0" * 63)


def test_config_differences(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "key string, value string")
    b = spark.createDataFrame([("x", "2"), ("y", None), ("w", "4")], "key string, value string")
    assert sorted(map(tuple, c.config_differences(a, b, ["w"]).collect())) == [("x", "1", "2"), ("z", "3", None)]


def test_budgets():
    one = {"stages": [{"name": "stage1"}]}
    assert c.budget_problems(one | {"max_steps": 10}) == [] and c.budget_problems(one | {"max_model_tokens": 5}) == []
    assert c.budget_problems({"max_steps": 0}) == ["max_steps", "schedule_steps"]
    assert c.budget_problems({"max_steps": 10, "schedule_steps": 11}) == ["schedule_beyond_cap"]
    assert c.budget_problems({"max_steps": 20, "schedule_steps": 30, "schedule_start_step": 10}) == []
    assert c.budget_problems({"max_steps": 20, "schedule_start_step": 20}) == ["schedule_start_step"]
    assert c.budget_problems(one | {"max_model_tokens": True}) == ["max_model_tokens"]
    assert c.budget_problems({"stages": [{"name": "stage1"}] * 2, "max_model_tokens": 5}) == ["token_budget_stages"]
