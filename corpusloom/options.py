"""Typed options for the analysis steps; the defaults are those of a full-size corpus run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

TEXT_SOURCES = ("title", "abstract", "both")
PROCESSING_LEVELS = ("raw", "lemmatized")
ID_TYPES = {"pubmed": "bigint", "arxiv": "string"}

# where each option lives in a nested configuration mapping
_CONFIG_KEYS = {
    "processing": ("processing",),
    "text_source": ("text_source",),
    "embedding_dim": ("embedding_dim",),
    "batch_start": ("batches", "start"),
    "batch_end": ("batches", "end"),
    "random_seed": ("random_seed",),
    "exclude_missing_abstract": ("exclude_articles", "missing_abstract"),
    "exclude_missing_title": ("exclude_articles", "missing_title"),
    "min_length": ("tokenization", "min_length"),
    "token_min_freq": ("cooccurrence", "token_min_freq"),
    "subsample_num_articles": ("cooccurrence", "subsample_num_articles"),
    "token_min_cor": ("token_min_cor",),
    "ngram_min_freq": ("ngram_min_freq",),
    "min_article_ratio": ("filtering", "min_article_ratio"),
    "max_article_ratio": ("filtering", "max_article_ratio"),
    "num_clusters": ("clustering", "num_clusters"),
    "projection_max_articles": ("umap", "max_articles"),
    "n_neighbors": ("umap", "n_neighbors"),
    "metric": ("umap", "metric"),
    "raster_max_articles": ("datashader", "max_articles"),
    "raster_width": ("datashader", "width"),
    "raster_height": ("datashader", "height"),
    "clip_quantile": ("datashader", "clip_quantile"),
    "encoder_max_length": ("bert", "max_length"),
    "lowercase_corpus": ("bert", "lowercase_corpus"),
}


@dataclass(frozen=True)
class Options:
    processing: str = "raw"
    text_source: str = "both"
    id_type: str | None = None
    embedding_dim: int = 768
    batch_start: int = 1
    batch_end: int = 100
    random_seed: int = 321
    exclude_missing_abstract: bool = True
    exclude_missing_title: bool = True
    min_length: int = 3
    token_min_freq: int = 10_000
    subsample_num_articles: int | None = None  # None: all articles, here and below
    token_min_cor: float = 0.15
    ngram_min_freq: int = 100
    min_article_ratio: float = 0.001
    max_article_ratio: float = 0.5
    num_clusters: int = 10
    projection_max_articles: int | None = None
    n_neighbors: int = 15
    metric: str = "cosine"  # of neighbours and projections
    raster_max_articles: int | None = None
    raster_width: int = 1000
    raster_height: int = 1000
    clip_quantile: float = 0.995
    encoder_max_length: int = 512
    lowercase_corpus: bool = False

    def __post_init__(self):
        if self.text_source not in TEXT_SOURCES:
            raise ValueError(f"text_source must be one of {TEXT_SOURCES}")
        if self.processing not in PROCESSING_LEVELS:
            raise ValueError(f"processing must be one of {PROCESSING_LEVELS}")

    @classmethod
    def from_config(cls, config: Mapping) -> Options:
        """Read the nested configuration mapping users keep in their YAML file."""
        found = {}
        for field in fields(cls):
            value = config
            for key in _CONFIG_KEYS.get(field.name, ("id_type",)):
                value = value.get(key) if isinstance(value, Mapping) else None
            if value is not None:
                found[field.name] = value
        if "corpus" in config:
            found.setdefault("id_type", ID_TYPES[config["corpus"]])
        return cls(**found)
