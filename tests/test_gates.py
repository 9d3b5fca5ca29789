import json

import pytest

from strandwork.operators import contracts as c

SEARCH = c.SearchProtocol("all", "forward", "hits-1")
TOPOLOGIES = {"one": {"main": (SEARCH,)}}
TERMS = c.Terms("p-1", "own-1", ("a", "b"), ("x", "y"), ("check-1",))
FOUND = {"query_scope": "all", "search_orientation": "forward", "normalized_hit_table_schema": "hits-1", "sensitivity": 7.5, "maximum_evalue": 0.001, "configured_candidate_cap": 1_000_000, "maximum_emitted_hits_for_one_evaluation_query": 5, "all_emitted_hit_counts_below_cap": True}
LIMITS = {"minimum_sequence_identity": 0.3, "minimum_query_coverage": 0.8, "minimum_target_coverage": 0.8, "maximum_evalue": 0.001, "coverage_mode": 0}


def release():
    shards = {"train": [{}], "validation": [{}]}
    return {"protocol": "p-1", "status": "verified", "global_exact_ownership": {"protocol": "own-1"}, "verification": {"global_train_exact_duplicate_intersection": 0}, "decontamination": {"scope": "all_evaluation_splits", "homology_exclusion_receipt_sha256": "0" * 64, "thresholds": LIMITS, "search_contracts": {"main": FOUND}, "evaluation_protocols": ["b", "a", "c"]}, "sources": {"x": shards, "y": shards}}


def test_release_document():
    assert c.release_problems(release(), TERMS, TOPOLOGIES) == []
    broken = release()
    broken["status"] = "draft"
    broken["decontamination"] |= {"thresholds": LIMITS | {"maximum_evalue": 0.01}, "evaluation_protocols": ["a"], "search_contracts": {"main": FOUND | {"sensitivity": 5}}}
    broken["sources"]["y"] = {"train": [], "validation": [{}]}
    assert c.release_problems(broken, TERMS, TOPOLOGIES) == ["status", "decontamination.thresholds.maximum_evalue", "decontamination.evaluation_protocols", "sources.y.train", "search.main"]
    assert len(c.release_problems(None, TERMS, TOPOLOGIES)) > 10 and len(c.release_problems({}, TERMS, TOPOLOGIES)) > 10


def test_corpus_gate_fails_closed():
    contract = {"status": "verified", "protocol": "p-1", "scope_used_for_training": "all evaluation splits", "blocked_benchmark_candidates_are_protected": True, "evaluation_protocols": ["a", "b"], "thresholds": LIMITS, "search_contracts": {"main": FOUND}}
    manifest = {"decontamination": {"homology_exclusion": True, "homology_exclusion_receipt_sha256": "r", "homology_contract": contract}}
    none = {"train_excluded_intersection": 0, "validation_excluded_intersection": 0, "train_validation_intersection": 0}
    proof = {"status": "verified", "protocol": "check-1", "manifest_sha256": "m", "homology_exclusion_receipt_sha256": "r", "sources": {"x": none, "y": none}}
    assert c.corpus_problems(manifest, proof, "m", TERMS, TOPOLOGIES) == []
    assert c.corpus_problems(manifest, proof, "other", TERMS, TOPOLOGIES) == ["verification.manifest_sha256"]
    assert c.corpus_problems(manifest, proof | {"sources": {"x": none | {"train_validation_intersection": 2}, "y": none}}, "m", TERMS, TOPOLOGIES) == ["verification.sources.x.train_validation_intersection"]
    assert len(c.corpus_problems(manifest, None, "m", TERMS, TOPOLOGIES)) >= 8 and c.corpus_problems({}, {}, "m", TERMS, TOPOLOGIES)


def test_unscreened_corpus_admits_it():
    manifest = {"protocol": "u", "sources": {"x": {}, "z": {"train": {"records": 3}}}, "decontamination": {"homology_exclusion": False, "status": "not_performed"}}
    receipt = {"status": "prepared_unscreened", "global_exact_duplicates": 0, "training_store": {"records": 3}}
    proof = {"status": "integrity_verified_unscreened", "evaluation_contamination_checked": False, "manifest_sha256": "m", "preparation_sha256": "p"}
    check = lambda *d: c.unscreened_problems(*d, {"manifest": "m", "receipt": "p"}, "u", ["x", "z"], "z")
    assert check(manifest, receipt, proof) == []
    assert check(manifest, receipt | {"training_store": {"records": 4}}, proof | {"evaluation_contamination_checked": True}) == ["receipt.training_store", "proof.evaluation_contamination_checked"]


def test_probe_receipt_is_bound():
    bound = {"checkpoint_sha256": "k", "dataset_manifest_sha256": "d", "pair_sampling_seed": 1, "maximum_pairs_per_class": 4096, "channels": 3}
    receipt = json.loads(json.dumps(c.probe_receipt([0.0, 1.5, -2.0], 0.25, 0.1, [[0.1, 0.9]], bound)))
    assert c.probe_problems(receipt, bound, 3) == []
    assert c.probe_problems(receipt, bound | {"checkpoint_sha256": "other"}, 3) == ["checkpoint_sha256"]
    assert c.probe_problems(receipt | {"coefficients": [0.0, float("nan"), 1.0], "intercept": None}, bound, 3) == ["coefficients", "intercept"]
    assert c.probe_problems(receipt, bound, 4) == ["coefficients"]


def test_accounting():
    samplers = {"a": {"size": 10, "epoch": 0, "cursor": 6, "prior": 2, "allow_resampling": False}, "b": {"size": 5, "epoch": 2, "cursor": 2, "allow_resampling": True}}
    saved = {"data_digest": "d", "step": 5, "world": 2, "batch": 2, "sequences": 20, "samplers": samplers}
    assert c.accounting_problems(saved, {"a": 10, "b": 5}, "d") == []
    assert c.accounting_problems(saved | {"step": 6}, {"a": 11, "b": 5}, "e") == ["data_digest", "sequences", "samplers.a.size"]
    worse = {"a": samplers["a"] | {"epoch": 1}, "b": samplers["b"] | {"cursor": 9}}
    assert c.accounting_problems(saved | {"samplers": worse}, {"a": 10, "b": 5}, "d") == ["samplers.a.epoch", "samplers.b.cursor", "draws"]


def test_runs_differ_in_their_seed_only():
    def run(seed, **config):
        evaluation = {"checkpoint_sha256": f"k{seed}", "profile": "search", "validation_mlm": {"sequences": 8192, "settings": 1}, "contact": {"evaluation_chains": 8192}}
        done = {"stop_reason": "max_model_tokens", "target_model_tokens": 100, "model_token_budget_reached": True, "model_tokens": 103, "model_token_overrun": 3, "last_optimizer_step_model_tokens": 10, "final_checkpoint": {"sha256": f"k{seed}"}}
        return {"config": {"seed": seed, "max_model_tokens": 100, **config}, "completion": done, "evaluation": evaluation}

    assert c.run_problems([run(1), run(2), run(3)]) == [] and c.run_problems([run(1)]) == ["runs"]
    assert c.run_problems([run(1), run(1)]) == ["seeds"] and c.run_problems([run(1), run(2, width=3)]) == ["recipe"]
    short = run(2)
    short["completion"] |= {"model_tokens": 99, "model_token_overrun": -1}
    short["evaluation"] |= {"checkpoint_sha256": "else", "contact": None}
    assert c.run_problems([run(1), short]) == ["1.evaluation.checkpoint_sha256", "1.evaluation.contact.evaluation_chains", "1.completion.model_token_overrun"]


def test_hardware_profiles(spark):
    gib = 1024**3
    rows = [("a", "NVIDIA L40S", 48 * gib)] * 4 + [("b", "NVIDIA H100 80GB HBM3", 80 * gib)] * 4 + [("c", "NVIDIA H100", 80 * gib)] * 3 + [("d", "L40S", 40 * gib)] * 4 + [("e", "L40", 48 * gib)] * 4
    got = {r["host"]: (r["devices"], r["profile"], r["seconds"]) for r in c.hardware_profile(spark.createDataFrame(rows, "host string, name string, memory_bytes long")).collect()}
    assert got == {"a": (4, "l40s-60m", 3600), "b": (4, "h100-20m", 1200), "c": (3, None, None), "d": (4, None, None), "e": (4, None, None)}


def test_recipes(tmp_path):
    (tmp_path / "r.json").write_text('{"stages": [1]}')
    assert c.load_recipe(str(tmp_path / "r.json")) == {"stages": [1]}
    for text in ("[1, 2]", "- a\n- b\n"):
        (tmp_path / "bad").write_text(text)
        with pytest.raises(ValueError):
            c.load_recipe(str(tmp_path / "bad"))
