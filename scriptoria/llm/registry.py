"""Queries of this package, by name."""

from . import (  # noqa: F401
    centroids,
    common,
    decontaminate,
    fertility,
    licenses,
    mixing,
    packing,
    ppm,
    private,
    ring,
    simhash,
    suffix_dedup,
    turns,
    wrappers,
)


def queries() -> dict:
    import corpus_pipeline

    return common.QUERIES | {"pipeline": corpus_pipeline.run}


def oracles() -> dict:
    import corpus_pipeline

    return common.ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
