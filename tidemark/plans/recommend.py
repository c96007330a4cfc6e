"""From raw events to recommendations: each step of the recommender over whole tables, for all users at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import affinity, candidates, rerank, rollup, topics
from tidemark.runtime import cut
from tidemark.sources import entities as E


def _kept(f: Callable[[Recommender], DataFrame]) -> cached_property:
    """A step that several later ones read: computed once and kept in the shared folder, as the tables it stands for are.

    Later plans start from it, so that they stay short, and a lost executor costs only a read.
    """
    return cached_property(lambda self: cut(f(self)))


class Recommender:
    """The tables of one folder and what follows from them; steps that others build on run once, when first read."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.now = E.as_of()

    def _table(self, f) -> DataFrame:
        return f(self.spark, self.folder)

    events = _kept(lambda self: self._table(E.events))
    content = _kept(lambda self: self._table(E.content))
    keys = cached_property(lambda self: self._table(E.content_keys))
    sources = cached_property(lambda self: self._table(E.sources))
    topics = cached_property(lambda self: self._table(E.topics))
    content_topics = cached_property(lambda self: self._table(E.content_topics))
    source_topics = cached_property(lambda self: self._table(E.source_topics))
    users = _kept(lambda self: self._table(E.users))
    preferences = cached_property(lambda self: self._table(E.topic_preferences))
    subscriptions = _kept(lambda self: self._table(E.subscriptions))
    saved = _kept(lambda self: self._table(E.saved))
    inbox = cached_property(lambda self: lambda follows, entries: E.inbox_states(follows.join(entries, "source_id")))
    curated = cached_property(lambda self: self._table(E.curated))
    links = _kept(lambda self: topics.closure(self.topics))

    feedback_daily = cached_property(lambda self: rollup.content_feedback_daily(self.events, self.keys))
    signals_daily = cached_property(lambda self: rollup.source_signals_daily(self.events))
    content_halo = _kept(lambda self: rollup.content_halo(rollup.content_halo_daily(self.events), self.content))
    source_halo = _kept(lambda self: rollup.source_halo(rollup.source_halo_daily(self.events, self.keys)))
    feedback = _kept(lambda self: affinity.user_content_feedback(self.feedback_daily, self.content, self.now))
    source_affinity = _kept(lambda self: affinity.user_source_affinity(self.feedback, self.keys, self.signals_daily, self.subscriptions, self.now))
    topic_affinity = _kept(lambda self: affinity.user_topic_affinity(self.preferences, self.feedback, self.source_affinity, self.content_topics, self.source_topics, self.links, self.now))
    context = _kept(lambda self: affinity.user_context(self.users, self.subscriptions, self.topic_affinity, self.source_affinity))
    buckets = cached_property(lambda self: candidates.content_buckets(self.users, self.keys, self.inbox, self.subscriptions, self.saved, self.feedback, self.context, self.content_topics, self.source_topics, self.content_halo, self.curated, self.now))
    content_candidates = cached_property(lambda self: candidates.content_candidates(self.buckets, self.keys, self.sources, self.topics, self.topic_affinity, self.source_affinity, self.content_topics, self.source_topics, self.content_halo, self.source_halo, self.curated, self.feedback, self.now))
    source_candidates = _kept(lambda self: candidates.source_candidates(self.users, self.sources, self.keys, self.subscriptions, self.topics, self.topic_affinity, self.source_affinity, self.context, self.source_topics, self.source_halo, self.now))
    scored_content = cached_property(lambda self: rerank.scored_content(self.content_candidates, self.subscriptions, self.now))
    scored_sources = cached_property(lambda self: rerank.scored_sources(self.source_candidates))
    subtopics = cached_property(lambda self: topics.subtopics(self.topics, self.links, self.topic_affinity, self.preferences, self.feedback, self.source_affinity, self.content_topics, self.source_topics))

    def preview(self, selected: list[str], languages: list[str]) -> DataFrame:
        rows = candidates.source_preview(selected, languages, self.sources, self.keys, self.topics, self.links, self.source_topics, self.source_halo, self.now)
        return rerank.scored_preview(rows)

    def recommend_content(self, limit: int = 20, carried: tuple[str, ...] = ()) -> DataFrame:
        return rerank.diverse_content(self.scored_content, limit, carried)

    def recommend_sources(self, limit: int = 20) -> DataFrame:
        return rerank.diverse_sources(self.scored_sources, limit)
