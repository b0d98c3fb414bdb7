"""Configuration trees with inheritance: driver-side dictionaries, no Spark."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from glossmill.operators.checks import ConfigError

# Names of metrics and models that mean the same.
ALIASES = {"kendall": "kendall_tau", "xgb": "xgboost", "gradient_boosting": "gbr"}


def merge(base: Mapping, over: Mapping) -> dict:
    """`over` on top of `base`: dictionaries merge, lists and scalars replace."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def read(path: Path) -> dict:
    """YAML or JSON file as a dictionary."""
    text = path.read_text()
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ConfigError("PyYAML is needed for YAML files", path=str(path)) from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def resolve(path: str, seen: tuple[Path, ...] = ()) -> dict:
    """Configuration with what it inherits merged below it; cycles raise. `_lineage` lists the files, nearest last."""
    p = Path(path).resolve()
    if p in seen:
        raise ConfigError("configurations inherit each other", files=[str(s) for s in (*seen, p)])
    if not p.exists():
        raise ConfigError("no such configuration", path=str(p))
    own = read(p)
    out: dict = {"_lineage": []}
    parents = own.pop("inherits", [])
    for parent in [parents] if isinstance(parents, str) else parents:
        up = Path(parent)
        near = next((c for c in (up, Path.cwd() / up, p.parent / up) if c.exists()), up)
        below = resolve(str(near), (*seen, p))
        lineage = out["_lineage"] + below["_lineage"]
        out = merge(out, below) | {"_lineage": lineage}
    return merge(out, own) | {"_lineage": [*out["_lineage"], str(p)]}


def normalize(names: list[str]) -> list[str]:
    """Metric or model names by their canonical alias, in order, once each."""
    return list(dict.fromkeys(ALIASES.get(n.lower(), n.lower()) for n in names))


def validate(config: Mapping, required: Mapping[str, type]) -> None:
    """Raise for missing or mistyped dotted keys."""
    for key, kind in required.items():
        node: object = config
        for part in key.split("."):
            if not isinstance(node, Mapping) or part not in node:
                raise ConfigError("missing configuration", key=key)
            node = node[part]
        if not isinstance(node, kind):
            raise ConfigError("wrong type", key=key, expected=kind.__name__, found=type(node).__name__)


#: Checks of a value: what it must be, and the test.
KINDS: dict[str, tuple[str, Callable[[object], bool]]] = {
    "text": ("a text that isn't blank", lambda v: isinstance(v, str) and bool(v.strip())),
    "flag": ("true or false", lambda v: isinstance(v, bool)),
    "positive": ("a whole number over 0", lambda v: isinstance(v, int) and not isinstance(v, bool) and v > 0),
    "folds": ("a whole number over 1", lambda v: isinstance(v, int) and not isinstance(v, bool) and v > 1),
    "count": ("a whole number or null", lambda v: v is None or isinstance(v, int) and not isinstance(v, bool) and v >= 0),
    "number": ("a number or null", lambda v: v is None or isinstance(v, (int, float)) and not isinstance(v, bool)),
    "list": ("a list", lambda v: isinstance(v, list)),
    "texts": ("a list of different texts", lambda v: isinstance(v, list) and all(isinstance(x, str) and x.strip() for x in v) and len(set(v)) == len(v)),
    "dict": ("a dictionary", lambda v: isinstance(v, Mapping)),
}
#: Blocks of a configuration: required (!) and optional keys with their kinds.
BLOCKS: dict[str, dict[str, str]] = {
    "paths": {"!data_dir": "text", "!output_dir": "text", "logs_dir": "text"},
    "schema": {"!id_column": "text", "!target_column": "text", "!l1_column": "text", "text_columns": "texts"},
    "experiment": {"name": "text", "type": "text"},
    "runtime": {"num_workers": "positive", "debug": "flag", "dry_run": "flag", "debug_subset_n": "count", "device": "text", "precision": "text"},
    "logging": {"level": "text", "log_to_file": "flag", "log_filename": "text"},
    "feature_groups": {"!enabled": "texts", "disabled": "texts"},
    "cv": {"enabled": "flag", "scheme": "text", "!folds": "folds", "shuffle": "flag", "random_state": "count", "stratify": "flag", "group_column": "text"},
    "evaluation": {"!metrics": "texts", "primary_metric": "text", "secondary_metrics": "texts"},
    "outputs": {"save_predictions": "flag", "save_models": "flag", "save_importance": "flag"},
    "data_usage": {"use_dev": "flag", "use_test": "flag"},
    "selection": {"mode": "text", "top_k": "positive", "threshold": "number"},
    "model": {"!name": "text", "params": "dict"},
    "data": {"splits": "dict", "keep_only_l1": "text", "drop_duplicates": "texts", "casts": "dict"},
    "defaults": {"random_seed": "count", "language": "text"},
}
# What may stand in a key.
CHOICES: dict[str, tuple[str, ...]] = {
    "logging.level": ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"), "cv.scheme": ("kfold", "group_kfold", "stratified_kfold"), "selection.mode": ("explicit", "families", "infer_numeric"),
    "evaluation.metrics": ("rmse", "mae", "pearson", "spearman", "kendall_tau"),
}


def validate_blocks(config: Mapping, blocks: Sequence[str] | None = None) -> dict:
    """The configuration with metric and model names by their canonical alias; raises at the first block that isn't as declared.

    Blocks that are absent pass unless `blocks` asks for them. Groups must not be enabled and disabled at once, the
    primary metric must be among the metrics, and unknown choices raise.
    """
    out = dict(config)
    for name in blocks or [b for b in BLOCKS if b in config]:
        block = out.get(name)
        if name not in BLOCKS or not isinstance(block, Mapping):
            raise ConfigError("bad block", block=name, known=sorted(BLOCKS))
        block = dict(block)
        for key, kind in BLOCKS[name].items():
            required, key = key.startswith("!"), key.lstrip("!")
            if key not in block:
                if required:
                    raise ConfigError("missing configuration", key=f"{name}.{key}")
                continue
            if not KINDS[kind][1](block[key]):
                raise ConfigError("wrong value", key=f"{name}.{key}", expected=KINDS[kind][0], found=block[key])
        if name == "evaluation":
            block |= {k: normalize(block[k]) for k in ("metrics", "secondary_metrics") if k in block}
            if "primary_metric" in block:
                block["primary_metric"] = normalize([block["primary_metric"]])[0]
                if block["primary_metric"] not in block["metrics"]:
                    raise ConfigError("the primary metric isn't computed", metric=block["primary_metric"])
        if name == "model":
            block["name"] = normalize([block["name"]])[0]
        for key, value in block.items():
            allowed = CHOICES.get(f"{name}.{key}")
            if allowed and any(v not in allowed for v in (value if isinstance(value, list) else [value])):
                raise ConfigError("unknown choice", key=f"{name}.{key}", found=value, known=allowed)
        if name == "feature_groups" and set(block["enabled"]) & set(block.get("disabled", [])):
            raise ConfigError("groups are enabled and disabled", groups=sorted(set(block["enabled"]) & set(block["disabled"])))
        if name == "feature_groups" and not block["enabled"]:
            raise ConfigError("no feature group is enabled")
        out[name] = block
    return out
