"""Keyword, filter and semantic search over the catalogue."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photarium.functions.labels import display_name
from photarium.operators.identity import group_serials
from photarium.plans.search_index import SubstringIndex
from photarium.sources.catalog import asset_date

PREFIX = "a photo of "
#: Words that find a group by its type.
TYPE_KEYWORDS = {"character": "角色 character 兽装 fursuit fur 兽", "person": "人物 person 真人 face 人"}


def has_cjk(text: Column) -> Column:
    return text.rlike("[一-鿿]")


class Dictionary:
    """Terms in one automaton, so that matching costs the text's length and its matches, not the number of terms.

    ``terms``: (term, words), the more important first. Longer terms are matched
    first, equal lengths in the given order; a matched span is taken, so that no
    shorter term sees it.
    """

    def __init__(self, terms: list[tuple[str, list[str]]]):
        self.terms = sorted(terms, key=lambda x: -len(x[0]))
        self.automaton = ahocorasick.Automaton()
        for n, (term, _) in enumerate(self.terms):
            if term:
                self.automaton.add_word(term, (*self.automaton.get(term, ()), n))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.always = [n for n, (term, _) in enumerate(self.terms) if not term]

    def words(self, text: str) -> list[str]:
        """English words of the terms that ``text`` holds, in the order of matching."""
        met: dict[int, list[int]] = {n: [] for n in self.always}
        for end, ns in self.automaton.iter(text) if len(self.automaton) else ():
            for n in ns:
                met.setdefault(n, []).append(end + 1 - len(self.terms[n][0]))
        taken, out = np.zeros(len(text), bool), {}
        for n in sorted(met):
            term, words = self.terms[n]
            spans = [(s, s + len(term)) for s in met[n]]
            found = not term
            for low, high in spans:
                if not taken[low:high].any():
                    taken[low:high] = found = True
            if found:
                out.update(dict.fromkeys(words))
        return list(out)

    def variants(self, text: str | None, limit: int) -> list[str]:
        text = (text or "").strip()
        if not text:
            return []
        words = self.words(text)
        found = [text, *([PREFIX + ", ".join(words)] if words else []), *(PREFIX + w for w in words)]
        return list(dict.fromkeys(found))[: max(1, limit)]


def expand_queries(queries: DataFrame, terms: DataFrame, limit: int = 4) -> DataFrame:
    """``query_id, variant_no, variant``: the raw text and prompts from a term dictionary.

    ``terms``: term, words (array), position; a dictionary of at most 100,000
    rows, else an error. See ``Dictionary``; each task builds one.
    """
    rows = terms.orderBy("position").limit(100_001).collect()
    if len(rows) > 100_000:
        raise ValueError("more than 100,000 terms")
    table = [(r["term"], list(r["words"])) for r in rows]
    kind = dict(queries.dtypes)["query_id"]

    def expand(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Dictionary(table)
        for pdf in it:
            out = [(q, n, v) for q, t in zip(pdf["query_id"], pdf["text"]) for n, v in enumerate(known.variants(t, limit))]
            yield pd.DataFrame(out, columns=["query_id", "variant_no", "variant"])

    return queries.select("query_id", "text").mapInPandas(expand, f"query_id {kind}, variant_no int, variant string")


def group_haystack(groups: DataFrame) -> DataFrame:
    """``id, type, created_at, label, haystack``: what a keyword can match."""
    words = F.create_map(*(F.lit(x) for kv in TYPE_KEYWORDS.items() for x in kv))
    named = groups.join(group_serials(groups), "id").withColumn("label", display_name(F.col("name"), F.col("type"), F.col("serial")))
    return named.withColumn("haystack", F.lower(F.concat_ws(" ", "name", "label", "id", F.coalesce(words[F.col("type")], F.lit("")))))


def group_index(groups: DataFrame, path: str | None = None) -> SubstringIndex:
    """Index over names, labels, ids and type words, newest group first."""
    return SubstringIndex.build(group_haystack(groups), "haystack", [F.desc("created_at"), "id"], path)


def asset_index(assets: DataFrame, favorites: DataFrame, path: str | None = None) -> SubstringIndex:
    """Index over asset names, in name order, with the day and the favourite mark."""
    marked = assets.join(favorites.select("name", F.lit(True).alias("fav")).distinct(), "name", "left")
    rows = marked.select("name", asset_date().alias("day"), F.coalesce("fav", F.lit(False)).alias("fav"))
    return SubstringIndex.build(rows, "name", ["name"], path)


def _filters(date_from: str | None, date_to: str | None, favorite_only: bool) -> Column:
    keep = F.lit(True)
    if date_from:
        keep &= F.col("day") >= date_from
    if date_to:
        keep &= F.col("day") <= date_to
    return keep & F.col("fav") if favorite_only else keep


def search_groups(groups: DataFrame | SubstringIndex, queries: DataFrame, limit: int = 15, type_filter: str = "all") -> DataFrame:
    """``query_id, section, rank, key``: groups whose name, label, id or type words contain the query."""
    index = groups if isinstance(groups, SubstringIndex) else group_index(groups)
    hits = index.search(queries, limit, None if type_filter == "all" else F.col("type") == type_filter)
    return hits.select("query_id", F.lit("groups").alias("section"), "rank", F.col("id").alias("key"))


def search_assets(assets: DataFrame | SubstringIndex, favorites: DataFrame | None, queries: DataFrame, limit: int = 20, date_from: str | None = None, date_to: str | None = None, favorite_only: bool = False, section: str = "photos") -> DataFrame:
    """Assets by name, inclusive dates and favourite mark, in name order; filters act on an empty query too."""
    index = assets if isinstance(assets, SubstringIndex) else asset_index(assets, favorites)
    hits = index.search(queries, limit, _filters(date_from, date_to, favorite_only))
    return hits.select("query_id", F.lit(section).alias("section"), "rank", F.col("name").alias("key"))


def catalog_search(tables: dict[str, DataFrame], queries: DataFrame, limit_groups: int = 15, limit_photos: int = 20, limit_favorites: int = 6, limit_semantic: int = 4, type_filter: str = "all", date_from: str | None = None, date_to: str | None = None, favorite_only: bool = False) -> DataFrame:
    """``query_id, section, rank, key`` over groups, photos, favorites and, if ``tables`` has
    ``vectors`` (key, vector) and ``query_vectors`` (query_id, variant, vector), semantic hits.

    ``tables`` may hold ``group_index`` and ``asset_index``, else they are built
    here, once for all sections. Favourites-only semantic search filters before it
    ranks.
    """
    from photarium.operators.vectors import vector_topk

    dates = {"date_from": date_from, "date_to": date_to}
    by_group = tables.get("group_index") or group_index(tables["groups"])
    by_name = tables.get("asset_index") or asset_index(tables["assets"], tables["favorites"])
    out = search_groups(by_group, queries, limit_groups, type_filter)
    out = out.union(search_assets(by_name, None, queries, limit_photos, **dates, favorite_only=favorite_only))
    out = out.union(search_assets(by_name, None, queries, limit_favorites, **dates, favorite_only=True, section="favorites"))
    if "vectors" in tables:
        alive = tables["favorites"].select(F.col("name").alias("key")) if favorite_only else None
        variants = tables["query_vectors"].select("query_id", F.col("query_id").alias("fused"), "vector")
        hits = vector_topk(tables["vectors"], variants, limit_semantic, fuse_by="fused", exclude_self=False, alive=alive)
        out = out.union(hits.select("query_id", F.lit("semantic").alias("section"), "rank", F.col("key").cast("string")))
    return out


def sort_groups(view: DataFrame, order: str = "count_desc", type_filter: str | None = None, text: str = "") -> DataFrame:
    """Group list by count_desc, count_asc, name_asc, name_desc or updated_desc; the id breaks ties."""
    keys = {"count_desc": [F.desc("n_assets")], "count_asc": [F.asc("n_assets")], "name_asc": [F.lower("name")], "name_desc": [F.desc(F.lower("name"))], "updated_desc": [F.desc("created_at")]}
    rows = view if type_filter is None else view.where(F.col("type") == type_filter)
    return rows.where(F.lower("name").contains(text.lower())).orderBy(*keys[order], "id")
