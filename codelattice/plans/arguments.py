"""Arguments of the stages, from flags or one JSON file."""

from __future__ import annotations

import argparse
import json
from dataclasses import MISSING, dataclass, field, fields
from typing import TypeVar, get_args, get_type_hints

A = TypeVar("A")


@dataclass
class Common:
    index_dir: str = ""
    colbert_checkpoint: str | None = None
    centroids: str | None = None
    collection: str | None = None
    n_passages: int | None = None
    id_field: str = "id"
    text_fields: list[str] = field(default_factory=lambda: ["text"])
    passage_mapping: str | None = None
    resume: bool = False


@dataclass
class Passaging:
    corpus: list[str] = field(default_factory=list)
    output: str = ""
    docid_field: str = "id"
    title_field: str = "title"
    body_fields: list[str] = field(default_factory=lambda: ["text"])
    length: int = 180
    stride: int = 90
    lower: bool = False
    tokenizer: str | None = None
    overwrite: bool = False


@dataclass
class Indexing(Common):
    with_weighted_assignments: bool = False
    assumed_doclen: int = 120
    training_queries: str | None = None
    max_n_queries: int = 8192
    reinit_centroids_at_end_of_epoch: bool = False
    training_embedding_samples: list[str] | None = None
    init_centroids: str | None = None
    n_sample_embeddings: int | None = None
    n_centroids: int | None = None
    overwrite_encoded_samples: bool = False
    with_kmeans_objective: bool = False
    max_difference_objective: bool = False
    entropy_regularization: float = 0.0
    use_soft_assignment: bool = False
    initial_temperature: float = 1.0
    final_temperature: float = 0.01
    temperature_anneal_steps: int | None = None
    max_steps: int = 1000
    per_device_train_batch_size: int = 256
    learning_rate: float = 1e-2
    weight_decay: float = 0.0
    max_grad_norm: float = 1.0
    warmup_steps: int = 0
    save_steps: int = 500
    driver_rows: int = 500_000
    clean_up_samples: bool = False
    retrain_centroids: bool = False
    do_sampling_only: bool = False
    do_merging_only: bool = False
    do_sampling: bool = True
    do_training: bool = True
    do_encoding: bool = True
    do_merging: bool = True
    overwrite: bool = False
    seed: int = 42

    def __post_init__(self) -> None:
        if sum((self.resume, self.retrain_centroids, self.do_sampling_only, self.do_merging_only)) > 1:
            raise ValueError("resume, retrain_centroids, do_sampling_only and do_merging_only exclude each other")
        if (self.with_kmeans_objective or self.entropy_regularization) and not self.use_soft_assignment:
            raise ValueError("the k-means objective and the entropy term need use_soft_assignment")


@dataclass
class Sweep(Common):
    """A search for each number of probes, with and without the rerank: see :func:`codelattice.plans.pipeline.run_sweep`."""

    queries: str = ""
    qrels: str | None = None
    metrics: list[str] = field(default_factory=lambda: ["nDCG@10", "nDCG@20", "P@10", "R@1000"])
    nprobes: list[int] = field(default_factory=lambda: [2, 4, 8, 16])
    topk: int = 1000
    limit: int = 100
    output: str | None = None


@dataclass
class Searching(Common):
    queries: str = ""
    qrels: str | None = None
    metrics: list[str] = field(default_factory=lambda: ["nDCG@10", "nDCG@20", "P@10", "R@1000"])
    search_output: str | None = None
    topk: int = 1000
    nprobe: int = 1
    limit: int = 100
    use_forward_index: bool = True
    load_full_index_to_memory: bool = False
    run_id: str = "codelattice"


def _boolean(text: str) -> bool:
    if text.lower() not in ("true", "false", "1", "0", "yes", "no"):
        raise argparse.ArgumentTypeError(f"not a boolean: {text}")
    return text.lower() in ("true", "1", "yes")


def parse(kind: type[A], argv: list[str]) -> A:
    """Flags, or a single path that ends in .json with the same names."""
    if len(argv) == 1 and argv[0].endswith(".json"):
        with open(argv[0], encoding="utf-8") as f:
            return kind(**json.load(f))
    parser, hints = argparse.ArgumentParser(prog=kind.__name__.lower()), get_type_hints(kind)
    for x in fields(kind):
        t = hints[x.name]
        t = next((a for a in get_args(t) if a is not type(None)), t) if type(None) in get_args(t) else t
        many = getattr(t, "__origin__", None) is list
        base = get_args(t)[0] if get_args(t) else t
        default = x.default_factory() if x.default is MISSING else x.default
        if base is bool:
            parser.add_argument(f"--{x.name}", type=_boolean, nargs="?", const=True, default=default)
        else:
            parser.add_argument(f"--{x.name}", type=base, nargs="+" if many else None, default=default)
    return kind(**vars(parser.parse_args(argv)))
