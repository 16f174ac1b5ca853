"""Which stages of a build have to run, given what is there."""

from __future__ import annotations

from dataclasses import dataclass

from codelattice.plans.arguments import Indexing


@dataclass(frozen=True)
class Present:
    """What an earlier build left: each is true only if it was completed."""

    samples: bool = False
    centroids: bool = False
    metadata: bool = False
    postings: bool = False
    index: bool = False


@dataclass(frozen=True)
class Stages:
    sampling: bool
    training: bool
    encoding: bool
    merging: bool


def plan(args: Indexing, there: Present) -> Stages:
    fresh = args.overwrite_encoded_samples or not there.samples
    if args.do_sampling_only:
        return Stages(fresh, False, False, False)
    if args.do_merging_only and there.metadata:
        if not there.centroids or not there.postings:
            raise ValueError("merging needs the centroids and the postings of a build")
        return Stages(False, False, False, True)
    if args.retrain_centroids:
        return Stages(fresh, True, True, True)
    if there.index and there.metadata and not args.overwrite:
        return Stages(False, False, False, False)
    training = args.do_training and not there.centroids
    encoding = args.do_encoding and (training or not there.postings)
    return Stages(args.do_sampling and training and fresh, training, encoding, args.do_merging)


def number_of_centroids(args: Indexing, known: int | None) -> int:
    """What is asked for, else that of existing (initial) centroids."""
    if args.n_centroids is not None:
        return args.n_centroids
    if known is None:
        raise ValueError("n_centroids is needed, or centroids to take it from")
    return known
