"""Checks of documents and configurations: declared rules, evaluated to a list of problems.

These run on the driver over single documents. :func:`config_differences` compares whole tables.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Callable[[Any], bool]]


def at(document: Any, path: str) -> Any:
    """The value at a dotted path, or None."""
    for name in path.split("."):
        document = document.get(name) if isinstance(document, Mapping) else None
    return document


def problems(document: Any, rules: Iterable[Rule]) -> list[str]:
    """The paths whose rule doesn't hold."""
    return [path for path, holds in rules if not holds(at(document, path))]


def equals(wanted: Any) -> Callable[[Any], bool]:
    return lambda x: x == wanted and isinstance(x, bool) == isinstance(wanted, bool)


def number(low: float = -math.inf, below: float = math.inf, whole: bool = False) -> Callable[[Any], bool]:
    """A number (not a boolean) in [low, below)."""
    return lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and low <= x < below and (not whole or float(x).is_integer())


def digest(x: Any) -> bool:
    return isinstance(x, str) and len(x) == 64 and all(c in "0123456789abcdefABCDEF" for c in x)


def safe_path(x: Any) -> bool:
    """Relative, without steps upwards."""
    return isinstance(x, str) and bool(x) and not x.startswith("/") and ".." not in x.split("/")


@dataclass(frozen=True)
class SearchProtocol:
    """What a homology search must declare; tags are those of the release at hand."""

    scope: str
    orientation: str
    schema: str
    sources: tuple[str, ...] = ()
    audit_tag: str | None = None  # set where train records are the queries
    min_sensitivity: float = 7.5
    max_evalue: float = 0.001
    cap: int = 1_000_000
    min_audit: int = 8192
    receipts: tuple[str, ...] = field(default=())


def search_rules(p: SearchProtocol) -> list[Rule]:
    """Rules of one search: below its hit cap in either orientation, audited if train records query."""
    rules: list[Rule] = [
        ("query_scope", equals(p.scope)),
        ("search_orientation", equals(p.orientation)),
        ("normalized_hit_table_schema", equals(p.schema)),
        ("sensitivity", number(p.min_sensitivity)),
        ("maximum_evalue", equals(p.max_evalue)),
        ("configured_candidate_cap", equals(p.cap)),
        *((r, digest) for r in p.receipts),
    ]
    if p.audit_tag is None:
        return rules + [("maximum_emitted_hits_for_one_evaluation_query", number(0, p.cap, whole=True)), ("all_emitted_hit_counts_below_cap", equals(True))]
    rules += [
        ("evaluation_target_sequences", number(1, p.cap, whole=True)),
        ("candidate_cap_unreachable", equals(True)),
        ("orientation_audit.protocol", equals(p.audit_tag)),
        ("orientation_audit.all_sources_reverse_recover_every_forward_pair", equals(True)),
        ("orientation_audit.minimum_sampled_training_sequences_per_source", number(p.min_audit, whole=True)),
        ("orientation_audit.sources", lambda x: isinstance(x, Mapping) and set(x) == set(p.sources)),
    ]
    for s in p.sources:
        base = f"orientation_audit.sources.{s}"
        rules += [(f"{base}.reverse_recovers_every_forward_pair", equals(True)), (f"{base}.forward_only_pairs", equals(0)), (f"{base}.sample_training_sequences", number(p.min_audit))]
    return rules


def search_problems(contracts: Any, topologies: Mapping[str, Mapping[str, tuple[SearchProtocol, ...]]]) -> list[str]:
    """Problems of a release's searches under the topology that names exactly its parts; each part may satisfy any one of its protocols."""
    if not isinstance(contracts, Mapping):
        return ["search_contracts"]
    for parts in topologies.values():
        if set(parts) == set(contracts):
            return [part for part, options in parts.items() if all(problems(contracts[part], search_rules(o)) for o in options)]
    return ["topology"]


# Keys that a resumed run may change.
FREE_KEYS = ("max_steps", "max_model_tokens", "schedule_steps", "walltime_seconds", "stop_at_unix_time", "log_interval", "prefetch_batches", "warm_data_cache", "checkpoint_interval", "expected_world_size", "periodic_evaluation_interval", "periodic_evaluation_command", "data_capacity_headroom")


def resume_problems(saved: Mapping[str, Any], wanted: Mapping[str, Any], old_world: int, world: int, step: int, tokens: int) -> list[str]:
    """Why a run can't be continued under another configuration; empty if it can.

    Both configurations are flattened into facts that must agree: each setting that isn't free, each
    setting of a stage but its batch layout, and the global batches. Budgets, intervals and the rank
    layout may change. An end point must be named and lie ahead.
    """
    before, after = _facts(saved, saved, old_world), _facts(wanted, saved, world)
    if wanted.get("data_sampler") != "global":
        before, after = ({k: v for k, v in f.items() if not k.endswith(".micro_batch")} for f in (before, after))
    steady = [s.get("name") for s in wanted.get("stages", [])] == ["stage1"] and not wanted.get("stage1_cooldown_fraction")
    if steady:
        before.pop("schedule"), after.pop("schedule")
    ends = {"max_steps": step, "max_model_tokens": tokens}
    named = {k: wanted[k] for k in ends if wanted.get(k) is not None}
    changed = sorted((k for k in {*before, *after} if before.get(k) != after.get(k)), key=lambda k: (k == "schedule", k))
    return changed + ([] if named else ["endpoint"]) + [k for k, v in named.items() if v <= ends[k]]


def _facts(config: Mapping[str, Any], base: Mapping[str, Any], world: int) -> dict[str, Any]:
    """What a continuation may not change, by name. ``base`` supplies the resampling policy where ``config`` names none."""
    facts = {k: v for k, v in config.items() if k not in FREE_KEYS and k != "stages"}
    facts.setdefault("data_resampling", base.get("data_resampling", "allow"))
    facts["schedule"] = config.get("schedule_steps", config.get("max_steps"))
    stages = config.get("stages", [])
    facts["stages"] = len(stages)
    for i, stage in enumerate(stages):
        rows, passes = stage.get("micro_batch_size", 0) * world, stage.get("gradient_accumulation", 0)
        facts |= {f"stages.{i}.micro_batch": rows, f"stages.{i}.global_batch": rows * passes}
        facts |= {f"stages.{i}.{k}": v for k, v in stage.items() if k not in ("micro_batch_size", "gradient_accumulation")}
    return facts


def budget_problems(config: Mapping[str, Any]) -> list[str]:
    """What is wrong with a run's step and token budgets; empty if they are consistent.

    The schedule's length defaults to the step cap and may not exceed it, unless the run
    continues from a start step, which both must exceed. A token budget is a positive whole
    number and needs a single constant first stage.
    """
    cap = config.get("max_steps")
    length, start = config.get("schedule_steps", cap), config.get("schedule_start_step", 0)
    tokens, stages = config.get("max_model_tokens"), config.get("stages", [])
    positive = number(1, whole=True)
    checks = [
        ("max_steps", cap is None or positive(cap)),
        ("schedule_steps", length is None or positive(length)),
        ("schedule_start_step", not start or (start > 0 and all(x is not None and x > start for x in (cap, length)))),
        ("schedule_beyond_cap", bool(start) or cap is None or length is None or length <= cap),
        ("max_model_tokens", tokens is None or (isinstance(tokens, int) and positive(tokens))),
        ("token_budget_stages", tokens is None or ([s.get("name") for s in stages] == ["stage1"] and not config.get("stage1_cooldown_fraction"))),
    ]
    return [name for name, holds in checks if not holds]


def stage_steps(total: int, stages: int, schedule: int | None = None, fraction: float = 2 / 3, consumed: int = 0) -> list[int]:
    """Steps left per stage of a one- or two-stage run."""
    if stages == 1:
        return [total - consumed]
    first = min(total, math.ceil((schedule or total) * fraction))
    return [max(0, first - consumed), max(0, total - max(first, consumed))]


def transfer_rates(width: float, layers: float, rate: float = 6e-4, decay: float = 0.01, base_width: float = 512, base_layers: float = 16) -> tuple[float, float]:
    """Learning rate and weight decay carried from a base width and depth to another."""
    moved = rate * base_width / width * math.sqrt(base_layers / layers)
    return moved, rate * decay / moved


def utilisation(parameters: float, tokens_per_second: float, peak_tflops: float, world: int) -> float:
    """Model FLOPs used over those available: six per parameter and token."""
    return 6 * parameters * tokens_per_second / (peak_tflops * 1e12 * world)


def config_differences(left: DataFrame, right: DataFrame, free: Iterable[str] = ()) -> DataFrame:
    """``key, old, new`` where two ``key, value`` tables differ (null-safe), but for the keys that may."""
    a, b = left.select("key", F.col("value").alias("old")), right.select("key", F.col("value").alias("new"))
    return a.join(b, "key", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).where(~F.col("key").isin(list(free)) if list(free) else F.lit(True))


@dataclass(frozen=True)
class Terms:
    """What a release, or a corpus prepared from one, must declare; tags and names are those of the release at hand."""

    protocol: str
    ownership: str
    evaluations: tuple[str, ...]
    sources: tuple[str, ...]
    verification: tuple[str, ...] = ()
    identity: float = 0.30
    coverage: float = 0.80
    evalue: float = 0.001


def holds_all(wanted: Iterable[str]) -> Callable[[Any], bool]:
    names = set(wanted)
    return lambda x: isinstance(x, (list, tuple, Mapping)) and names <= set(x)


def threshold_rules(base: str, t: Terms) -> list[Rule]:
    """The thresholds of an outside search, below ``base``."""
    wanted = {"minimum_sequence_identity": t.identity, "minimum_query_coverage": t.coverage, "minimum_target_coverage": t.coverage, "maximum_evalue": t.evalue, "coverage_mode": 0}
    return [(f"{base}.{name}", equals(value)) for name, value in wanted.items()]


def release_problems(manifest: Any, t: Terms, topologies: Mapping[str, Mapping[str, tuple[SearchProtocol, ...]]]) -> list[str]:
    """Why a release's document can't be trusted (empty if it can): ownership, screening, searches, sources.

    Its shards are held against :func:`strandwork.operators.planning.shard_rules`, as a table.
    """
    rules: list[Rule] = [
        ("protocol", equals(t.protocol)),
        ("status", equals("verified")),
        ("global_exact_ownership.protocol", equals(t.ownership)),
        ("verification.global_train_exact_duplicate_intersection", equals(0)),
        ("decontamination.scope", equals("all_evaluation_splits")),
        ("decontamination.homology_exclusion_receipt_sha256", digest),
        *threshold_rules("decontamination.thresholds", t),
        ("decontamination.evaluation_protocols", holds_all(t.evaluations)),
        ("sources", lambda x: isinstance(x, Mapping) and set(x) == set(t.sources)),
        *((f"sources.{s}.{split}", lambda x: isinstance(x, (list, tuple)) and len(x) > 0) for s in t.sources for split in ("train", "validation")),
    ]
    searched = search_problems(at(manifest, "decontamination.search_contracts"), topologies)
    return problems(manifest, rules) + [f"search.{x}" for x in searched]


def corpus_problems(manifest: Any, verification: Any, manifest_digest: str, t: Terms, topologies: Mapping[str, Mapping[str, tuple[SearchProtocol, ...]]]) -> list[str]:
    """Why a prepared corpus may not be trained on; fails closed where anything is missing.

    The verification must name this very manifest and exclusion receipt, and have found no overlap in any source.
    """
    contract = "decontamination.homology_contract"
    rules: list[Rule] = [
        ("decontamination.homology_exclusion", equals(True)),
        ("decontamination.homology_exclusion_receipt_sha256", lambda x: isinstance(x, str)),
        (f"{contract}.status", equals("verified")),
        (f"{contract}.protocol", equals(t.protocol)),
        (f"{contract}.scope_used_for_training", equals("all evaluation splits")),
        (f"{contract}.blocked_benchmark_candidates_are_protected", equals(True)),
        (f"{contract}.evaluation_protocols", holds_all(t.evaluations)),
        *threshold_rules(f"{contract}.thresholds", t),
    ]
    none = ("train_excluded_intersection", "validation_excluded_intersection", "train_validation_intersection")
    proof: list[Rule] = [
        ("status", equals("verified")),
        ("protocol", lambda x: x in t.verification),
        ("manifest_sha256", equals(manifest_digest)),
        ("homology_exclusion_receipt_sha256", equals(at(manifest, "decontamination.homology_exclusion_receipt_sha256"))),
        *((f"sources.{s}.{k}", equals(0)) for s in t.sources for k in none),
    ]
    searched = search_problems(at(manifest, f"{contract}.search_contracts"), topologies)
    return problems(manifest, rules) + [f"search.{x}" for x in searched] + [f"verification.{x}" for x in problems(verification, proof)]


def unscreened_problems(manifest: Any, receipt: Any, proof: Any, digests: Mapping[str, str], protocol: str, sources: Iterable[str], added: str) -> list[str]:
    """Why an openly unscreened corpus isn't what it says; its documents must admit that no screening was done.

    ``digests``: of the ``manifest`` and the preparation ``receipt``; ``added``: the source prepared without a screen.
    """
    documents: dict[str, tuple[Any, list[Rule]]] = {
        "manifest": (manifest, [("protocol", equals(protocol)), ("sources", lambda x: isinstance(x, Mapping) and set(x) == set(sources)), ("decontamination.homology_exclusion", equals(False)), ("decontamination.status", equals("not_performed"))]),
        "receipt": (receipt, [("status", equals("prepared_unscreened")), ("global_exact_duplicates", equals(0)), ("training_store", lambda x: x is not None and x == at(manifest, f"sources.{added}.train"))]),
        "proof": (proof, [("status", equals("integrity_verified_unscreened")), ("evaluation_contamination_checked", equals(False)), ("manifest_sha256", equals(digests["manifest"])), ("preparation_sha256", equals(digests["receipt"]))]),
    }
    return [f"{name}.{x}" for name, (document, rules) in documents.items() for x in problems(document, rules)]


def probe_receipt(coefficients: Iterable[float], intercept: float, strength: float, trace: list[Any], bound: Mapping[str, Any]) -> dict[str, Any]:
    """The document of a fitted probe, bound to what it was fitted on (``bound``: digests, seed, caps)."""
    return {"schema_version": 1, **bound, "coefficients": [float(x) for x in coefficients], "intercept": float(intercept), "selected_C": float(strength), "validation_trace": trace}


def probe_problems(receipt: Any, bound: Mapping[str, Any], channels: int) -> list[str]:
    """Why a probe can't be applied here: bound to something else, or not made of ``channels`` finite numbers."""
    finite = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)
    rules: list[Rule] = [("schema_version", equals(1)), *((k, equals(v)) for k, v in bound.items())]
    rules += [("coefficients", lambda x: isinstance(x, list) and len(x) == channels and all(map(finite, x))), ("intercept", finite), ("selected_C", finite), ("validation_trace", lambda x: isinstance(x, list))]
    return problems(receipt, rules)


def accounting_problems(saved: Mapping[str, Any], records: Mapping[str, int], data_digest: str) -> list[str]:
    """Whether a saved run's counters add up: sequences from steps, draws from cursors, and cursors inside their sources.

    ``saved``: ``data_digest, step, sequences, world, batch, samplers`` (per source ``size, epoch, cursor, prior,
    allow_resampling``); ``records``: what the data holds per source.
    """
    out = [] if saved.get("data_digest") == data_digest else ["data_digest"]
    if saved["sequences"] != saved["batch"] * saved["world"] * saved["step"]:
        out.append("sequences")
    draws = 0
    for name, s in saved["samplers"].items():
        draws += s.get("prior", 0) + s["cursor"] if s["epoch"] == 0 else s["epoch"] * s["size"] + s["cursor"]
        checks = {"size": s["size"] == records.get(name), "cursor": 0 <= s["cursor"] <= s["size"], "epoch": s["epoch"] == 0 or s["allow_resampling"]}
        out += [f"samplers.{name}.{k}" for k, holds in checks.items() if not holds]
    return out if draws == saved["sequences"] else [*out, "draws"]


def run_problems(runs: list[Mapping[str, Any]], profile: str = "search", units: int = 8192) -> list[str]:
    """Why runs can't be summarised together: they must differ in nothing but the seed, have spent their budgets, and be evaluated whole.

    A run: ``config`` (with ``seed``), ``completion``, ``evaluation``.
    """
    if len(runs) < 2:
        return ["runs"]
    recipes = [{k: v for k, v in r["config"].items() if k != "seed"} for r in runs]
    seeds = [r["config"].get("seed") for r in runs]
    settings = [at(r["evaluation"], "validation_mlm.settings") for r in runs]
    shared = {"seeds": len(set(seeds)) == len(seeds), "recipe": all(x == recipes[0] for x in recipes), "settings": all(x == settings[0] for x in settings)}
    out = [name for name, holds in shared.items() if not holds]
    for i, r in enumerate(runs):
        done, budget = r["completion"], r["config"].get("max_model_tokens")
        rules: list[Rule] = [("checkpoint_sha256", equals(at(done, "final_checkpoint.sha256"))), ("profile", equals(profile)), ("validation_mlm.sequences", equals(units)), ("contact.evaluation_chains", equals(units))]
        out += [f"{i}.evaluation.{x}" for x in problems(r["evaluation"], rules)]
        if budget is not None:
            over = (done.get("model_tokens") or 0) - budget
            spent: list[Rule] = [("stop_reason", equals("max_model_tokens")), ("target_model_tokens", equals(budget)), ("model_token_budget_reached", equals(True)), ("model_token_overrun", lambda x, over=over, last=done.get("last_optimizer_step_model_tokens") or 0: x == over and 0 <= over < last)]
            out += [f"{i}.completion.{x}" for x in problems(done, spent)]
    return out


# Device names of the declared profiles, with seconds of a round.
HARDWARE = [("l40s-60m", r"\bL40S\b", 3600), ("h100-20m", r"\bH100\b", 1200)]


def hardware_profile(devices: DataFrame) -> DataFrame:
    """``host, devices, profile, seconds`` of hosts (``host, name, memory_bytes``); null where no profile covers a host.

    A host needs four devices of one name and at least 44 GiB each.
    """
    per = devices.groupBy("host").agg(F.count("*").alias("devices"), F.countDistinct("name").alias("names"), F.min("name").alias("name"), F.min("memory_bytes").alias("least"))
    fits = (F.col("devices") == 4) & (F.col("names") == 1) & (F.col("least") >= 44 * 1024**3)
    profile, seconds = F.lit(None).cast("string"), F.lit(None).cast("int")
    for name, pattern, time in reversed(HARDWARE):
        matched = fits & F.col("name").rlike(pattern)
        profile, seconds = F.when(matched, name).otherwise(profile), F.when(matched, time).otherwise(seconds)
    return per.select("host", "devices", profile.alias("profile"), seconds.alias("seconds"))


def load_recipe(path: str) -> dict[str, Any]:
    """A recipe file, JSON or (where a YAML parser is installed) YAML; anything but a mapping is refused."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        recipe = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ModuleNotFoundError as missing:
            raise ValueError(f"{path} is not JSON, and no YAML parser is installed") from missing
        recipe = yaml.safe_load(text)
    if not isinstance(recipe, dict):
        raise ValueError(f"{path} holds no mapping")
    return recipe
