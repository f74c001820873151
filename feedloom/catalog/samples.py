"""Negative samples of each split from the candidates and labels of that split."""

from __future__ import annotations

import re
from dataclasses import replace

from feedloom.catalog.inputs import orders
from feedloom.catalog.ranking import _sample_sql, user_lists
from feedloom.catalog.recall import SPARSE
from feedloom.catalog.sql import CTES, cte, sql
from feedloom.config import PRERANK_SAMPLING, RANK_SAMPLING
from feedloom.operators.itemcf import itemcf_candidates, itemcf_neighbors
from feedloom.operators.popular import popular_items
from feedloom.operators.user_lists import channel_arrays, merged_lists, sampled_lists, user_rows
from feedloom.session import stage


def split_lists(x, split):
    """Fused candidates of a split with its own outcomes.  Train users keep the items they have seen, among them their positives."""
    if split != "train":
        return user_lists(x, split)
    users, popular = x.train.select("user_id").distinct(), stage(popular_items(x.train), "popular")
    found = itemcf_candidates(x.sequences, itemcf_neighbors(x.train, SPARSE), replace(SPARSE, exclude_seen=False))
    return merged_lists(channel_arrays(user_rows(users, popular, None, found, x.train), popular))


def sampled(split, rules):
    def run(spark, sf):
        x = orders(spark, sf).staged()
        return sampled_lists(split_lists(x, split), split, rules).select("user_id", "video_id", "label")

    return run


QUERIES = {
    "negative_sample_train_split": sampled("train", PRERANK_SAMPLING),
    "negative_sample_val_split": sampled("val", PRERANK_SAMPLING),
    "rank_sample_val_split": sampled("val", RANK_SAMPLING),
}

cte(
    "pop_cand_train_o",
    ("popular_o", "users_train_o"),
    "SELECT user_id, video_id, 'popular' AS recall_source, CAST(source_score AS DOUBLE) AS source_score, popular_rank AS source_rank FROM users_train_o CROSS JOIN popular_o",
)
_CHAIN = ("cf_cand_o", "raw_o", "normed_o", "merged_o", "labelled_o")
for _split in ("train", "val"):
    _names = {n: f"{n.removesuffix('_o')}_{_split}_o" for n in _CHAIN} | {f"{n}_test_o": f"{n}_{_split}_o" for n in ("users", "pop_cand", "pairs")}
    _swap = lambda text, names=_names: re.sub(r"\b\w+\b", lambda m: names.get(m[0], m[0]), text)
    for _n in _CHAIN:
        _needs, _body = CTES[_n]
        if _n == "cf_cand_o" and _split == "train":
            _body = re.sub(r"WHERE NOT EXISTS \(.*\)\n", "", _body)
        cte(_names[_n], tuple(map(_swap, _needs)), _swap(_body))


def _own(text: str, split: str) -> str:
    """The sampling SQL over the labelled candidates of a split."""
    return sql(text[text.index("SELECT user_id, video_id, label FROM labelled_o") :].replace("labelled_o", f"labelled_{split}_o"), f"labelled_{split}_o")


ORACLES = {
    "negative_sample_train_split": _own(_sample_sql(5, 2026), "train"),
    "negative_sample_val_split": _own(_sample_sql(10, 2026), "val"),
    "rank_sample_val_split": _own(_sample_sql(8, 2043), "val"),
}
