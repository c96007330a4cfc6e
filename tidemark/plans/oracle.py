"""The tables and derived tables of the recommender as DuckDB SQL, for comparison with the Spark plans."""

from __future__ import annotations

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
_DECAY = "exp(-0.6931471805599453e0 * greatest(date_diff('microsecond', {at}, " + NOW + ") / 86400e6, 0e0) / 30e0)"


def _decay(at: str) -> str:
    return _DECAY.format(at=at)


def _n(kind: str) -> str:
    return f"count(*) FILTER (WHERE event_type = '{kind}')"


def _counts(*kinds: str) -> str:
    return ", ".join(f"{_n(k)} AS {k}_count" for k in kinds)


_SMOOTH = "least(1e0, (greatest(0e0, {raw}) * signals + 1.75e0) / greatest(signals + 5e0, 1e0))"
_C_RAW = "0.15e0*least(open_count,10)/10e0 + 0.35e0*least(ratio,1.5e0)/1.5e0 + 0.25e0*least(save_count,10)/10e0 + 0.20e0*least(mark_read_count,10)/10e0 - 0.20e0*least(dismiss_count,10)/10e0"
_S_RAW = "0.15e0*least(open_count,20)/20e0 + 0.25e0*least(visible_ms,600000)/600000e0 + 0.20e0*least(save_count,20)/20e0 + 0.15e0*least(mark_read_count,20)/20e0 + 0.25e0*least(subscribe_count,10)/10e0 - 0.15e0*least(dismiss_count,20)/20e0 - 0.20e0*least(unsubscribe_count,10)/10e0"
_BARRED = "NOT EXISTS (SELECT 1 FROM saved s WHERE s.user_id = {u} AND s.content_id = {c} AND s.archived_at IS NULL) AND NOT EXISTS (SELECT 1 FROM feedback b WHERE b.user_id = {u} AND b.content_id = {c} AND b.dismiss_count > 0)"
_SPEAKS = "(len(u.languages) = 0 OR c.language_code IS NULL OR list_contains(u.languages, c.language_code))"
_SECONDS = "CAST(greatest(1, ceil(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) / 220e0 * 60)) AS INTEGER)"

#: name -> SQL, in an order in which each uses only those before it.
TABLES = {
    "ev": """SELECT event_id AS id, user_id, CASE WHEN event_type <> 'signup' THEN CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) END AS content_id,
        CASE WHEN event_type = 'signup' THEN 'src' || (CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) % 20) END AS source_id,
        CASE event_type WHEN 'view' THEN 'impression' WHEN 'click' THEN 'open' WHEN 'purchase' THEN 'save' WHEN 'signup' THEN 'subscribe' WHEN 'error' THEN 'dismiss' END AS event_type,
        CAST(round(value * 1000) AS BIGINT) AS visible_ms, ts AS occurred_at FROM events""",
    "content": f"SELECT doc_id AS id, source AS source_id, lang AS language_code, {_SECONDS} AS estimated_read_seconds, {NOW} - to_days(CAST(doc_id % 60 AS INTEGER)) AS published_at FROM documents",
    "sources": "SELECT id, tier AS quality_tier, CASE tier WHEN 5 THEN 1e0 WHEN 4 THEN 0.8e0 WHEN 3 THEN 0.6e0 WHEN 2 THEN 0.35e0 ELSE 0.1e0 END AS editorial_score FROM (SELECT DISTINCT source AS id, 1 + CAST(regexp_extract(source, '(\\d+)', 1) AS INTEGER) % 5 AS tier FROM documents)",
    "topics": "SELECT id, replace(label, ' ', '-') AS slug, label, parent_id FROM (SELECT 'r' || r_regionkey AS id, lower(r_name) AS label, NULL AS parent_id FROM region UNION ALL SELECT 'n' || n_nationkey, lower(n_name), 'r' || n_regionkey FROM nation)",
    "content_topics": "SELECT doc_id AS content_id, 'n' || (doc_id % 25) AS topic_id, 0.5e0 + (doc_id % 5) / 10e0 AS confidence FROM documents",
    "source_topics": "SELECT source_id, topic_id, max(confidence) AS confidence FROM (SELECT id AS source_id, 'n' || (n % 25) AS topic_id, 0.5e0 + (n % 5) / 10e0 AS confidence FROM (SELECT id, CAST(regexp_extract(id, '(\\d+)', 1) AS INTEGER) AS n FROM sources) UNION ALL SELECT id, 'n' || ((n * 7 + 3) % 25), 0.4e0 FROM (SELECT id, CAST(regexp_extract(id, '(\\d+)', 1) AS INTEGER) AS n FROM sources)) GROUP BY ALL",
    "people": "SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN ['en'] WHEN 1 THEN ['de', 'en'] ELSE CAST([] AS VARCHAR[]) END AS languages FROM ev",
    "preferences": "SELECT user_id, 'r' || (user_id % 5) AS topic_id, 1e0 AS weight FROM people WHERE user_id % 3 = 0",
    "subscriptions": "SELECT DISTINCT user_id, source_id FROM ev WHERE event_type = 'subscribe'",
    "saved": "SELECT user_id, content_id, happened AS updated_at, CASE WHEN (user_id + content_id) % 11 = 0 THEN happened END AS archived_at, CASE WHEN (user_id + content_id) % 3 = 0 THEN 'read' ELSE 'unread' END AS read_state, (user_id + content_id) % 5 = 0 AS is_favorited FROM (SELECT user_id, content_id, max(occurred_at) AS happened FROM ev WHERE event_type = 'save' GROUP BY ALL)",
    "inbox": "SELECT user_id * 1000000 + c.id AS id, user_id, s.source_id, c.id AS content_id, published_at + INTERVAL 1 HOUR AS delivered_at, CASE WHEN (user_id + c.id) % 17 = 0 THEN published_at END AS dismissed_at, CASE WHEN (user_id + c.id) % 4 = 0 THEN 'read' ELSE 'unread' END AS read_state FROM subscriptions s JOIN content c ON c.source_id = s.source_id",
    "curated": "SELECT doc_id AS content_id, 0.5e0 + (doc_id % 5) / 10e0 AS curated_score, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 10 AS INTEGER) END AS source_rank FROM labels WHERE quality = 1 AND doc_id % 7 = 0",
    "closure": "SELECT id AS ancestor_id, id AS descendant_id, 0 AS depth FROM topics UNION ALL SELECT parent_id, id, 1 FROM topics WHERE parent_id IS NOT NULL",
    "owned": "SELECT ev.id, user_id, content_id, coalesce(ev.source_id, c.source_id) AS source_id, event_type, visible_ms, occurred_at FROM ev LEFT JOIN content c ON c.id = ev.content_id",
    "feedback_daily": f"SELECT user_id, content_id, CAST(occurred_at AS DATE) AS signal_date, max(source_id) AS source_id, {_counts('impression', 'open', 'save', 'favorite', 'mark_read', 'dismiss', 'heartbeat')}, CAST(sum(visible_ms) AS BIGINT) AS visible_ms, max(occurred_at) AS last_interacted_at FROM owned WHERE content_id IS NOT NULL GROUP BY user_id, content_id, CAST(occurred_at AS DATE)",
    "signals_daily": f"SELECT user_id, source_id, CAST(occurred_at AS DATE) AS signal_date, {_counts('impression', 'open', 'dismiss', 'subscribe', 'unsubscribe')}, max(occurred_at) AS last_interacted_at FROM ev WHERE content_id IS NULL AND source_id IS NOT NULL GROUP BY user_id, source_id, CAST(occurred_at AS DATE)",
    "content_daily": f"SELECT content_id, CAST(occurred_at AS DATE) AS halo_date, count(*) FILTER (WHERE event_type IN ('open','heartbeat','save','mark_read','dismiss')) AS signals, {_counts('impression', 'open', 'save', 'mark_read', 'dismiss')}, CAST(sum(visible_ms) AS BIGINT) AS visible_ms FROM ev WHERE content_id IS NOT NULL GROUP BY content_id, CAST(occurred_at AS DATE)",
    "source_daily": f"SELECT source_id, CAST(occurred_at AS DATE) AS halo_date, count(*) FILTER (WHERE event_type IN ('open','heartbeat','save','mark_read','dismiss','subscribe','unsubscribe')) AS signals, {_counts('impression', 'open', 'save', 'mark_read', 'dismiss', 'subscribe', 'unsubscribe')}, CAST(sum(visible_ms) AS BIGINT) AS visible_ms FROM owned WHERE source_id IS NOT NULL GROUP BY source_id, CAST(occurred_at AS DATE)",
    "content_halo": f"SELECT * EXCLUDE (ratio), {_SMOOTH.format(raw=_C_RAW)} AS score FROM (SELECT d.*, least(visible_ms / greatest(coalesce(estimated_read_seconds, 1) * 1000e0, 1000e0), 1.5e0) AS ratio FROM content_daily d LEFT JOIN content c ON c.id = d.content_id)",
    "source_halo": f"SELECT *, {_SMOOTH.format(raw=_S_RAW)} AS score FROM source_daily",
    "feedback": f"""SELECT *, least(greatest(0.20e0*least(open_count,1) + 0.60e0*read_ratio + 0.40e0*least(save_count,1) + 0.30e0*least(favorite_count,1) + 0.40e0*least(mark_read_count,1) - 0.50e0*least(dismiss_count,1), -1e0), 2e0) AS score
        FROM (SELECT f.*, least(visible_ms / greatest(coalesce(estimated_read_seconds, 1) * 1000e0, 1000e0), 1.5e0) AS read_ratio FROM (
          SELECT user_id, content_id, max(source_id) AS source_id, {", ".join(f"CAST(sum({k}_count) AS BIGINT) AS {k}_count" for k in ("impression", "open", "save", "favorite", "mark_read", "dismiss", "heartbeat"))}, CAST(sum(visible_ms) AS BIGINT) AS visible_ms, max(last_interacted_at) AS last_interacted_at
          FROM feedback_daily WHERE signal_date >= CAST({NOW} AS DATE) - 90 GROUP BY user_id, content_id) f LEFT JOIN content c ON c.id = f.content_id
          WHERE impression_count + open_count + save_count + favorite_count + mark_read_count + dismiss_count + heartbeat_count > 0)""",
    "source_affinity": f"""SELECT user_id, source_id, sum(score) AS score, CAST(sum(signals) AS BIGINT) AS signals, max(last_interacted_at) AS last_interacted_at FROM (
        SELECT user_id, coalesce(f.source_id, c.source_id) AS source_id, sum(score * {_decay("last_interacted_at")}) AS score, count(*) AS signals, max(last_interacted_at) AS last_interacted_at FROM feedback f LEFT JOIN content c ON c.id = f.content_id WHERE coalesce(f.source_id, c.source_id) IS NOT NULL GROUP BY user_id, coalesce(f.source_id, c.source_id)
        UNION ALL SELECT user_id, source_id, sum((0.90e0*subscribe_count - 0.90e0*unsubscribe_count - 0.60e0*dismiss_count + 0.15e0*open_count + 0.05e0*impression_count) * {_decay("last_interacted_at")}), sum(impression_count + open_count + dismiss_count + subscribe_count + unsubscribe_count), max(last_interacted_at) FROM signals_daily WHERE signal_date >= CAST({NOW} AS DATE) - 90 GROUP BY user_id, source_id
        UNION ALL SELECT user_id, source_id, 0.25e0, 1, {NOW} FROM subscriptions) GROUP BY user_id, source_id""",
    "topic_affinity": f"""SELECT user_id, topic_id, sum(score) AS score, CAST(sum(signals) AS BIGINT) AS signals, max(happened) AS last_interacted_at FROM (
        SELECT user_id, descendant_id AS topic_id, weight * 2 * pow(0.8e0, depth) AS score, 1 AS signals, {NOW} AS happened FROM preferences p JOIN closure l ON l.ancestor_id = p.topic_id
        UNION ALL SELECT user_id, ancestor_id, score * confidence * pow(0.7e0, depth) * {_decay("last_interacted_at")}, 1, last_interacted_at FROM feedback JOIN content_topics USING (content_id) JOIN closure ON descendant_id = topic_id
        UNION ALL SELECT user_id, ancestor_id, score * confidence * pow(0.75e0, depth), 1, last_interacted_at FROM source_affinity JOIN source_topics USING (source_id) JOIN closure ON descendant_id = topic_id) GROUP BY user_id, topic_id""",
    "context": """SELECT user_id, languages, coalesce((SELECT list(source_id ORDER BY source_id) FROM subscriptions s WHERE s.user_id = p.user_id), []) AS subscribed, coalesce(t.l, []) AS top_topics, coalesce(s.l, []) AS top_sources FROM people p
        LEFT JOIN (SELECT user_id, list(topic_id ORDER BY score DESC, topic_id) AS l FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, topic_id) AS n FROM topic_affinity WHERE score > 0) WHERE n <= 10 GROUP BY user_id) t USING (user_id)
        LEFT JOIN (SELECT user_id, list(source_id ORDER BY score DESC, source_id) AS l FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, source_id) AS n FROM source_affinity WHERE score > 0) WHERE n <= 10 GROUP BY user_id) s USING (user_id)""",
    "b_subscribed": f"SELECT i.user_id, i.content_id, row_number() OVER (PARTITION BY i.user_id ORDER BY delivered_at DESC, i.id DESC) AS n FROM inbox i JOIN content c ON c.id = i.content_id WHERE dismissed_at IS NULL AND published_at >= {NOW} - INTERVAL 30 DAY AND {_BARRED.format(u='i.user_id', c='i.content_id')}",
    "b_discovery": f"SELECT u.user_id, c.id AS content_id, row_number() OVER (PARTITION BY u.user_id ORDER BY published_at DESC, c.id DESC) AS n FROM people u, content c WHERE published_at >= {NOW} - INTERVAL 30 DAY AND {_SPEAKS} AND NOT EXISTS (SELECT 1 FROM subscriptions x WHERE x.user_id = u.user_id AND x.source_id = c.source_id) AND {_BARRED.format(u='u.user_id', c='c.id')}",
    "b_adjacent": f"SELECT u.user_id, c.id AS content_id, row_number() OVER (PARTITION BY u.user_id ORDER BY published_at DESC, c.id DESC) AS n FROM context u, content c WHERE published_at >= {NOW} - INTERVAL 60 DAY AND (EXISTS (SELECT 1 FROM content_topics t WHERE t.content_id = c.id AND list_contains(u.top_topics, t.topic_id)) OR EXISTS (SELECT 1 FROM source_topics t WHERE t.source_id = c.source_id AND list_contains(u.top_topics, t.topic_id)) OR list_contains(u.top_sources, c.source_id)) AND {_BARRED.format(u='u.user_id', c='c.id')}",
    "b_trending": f"SELECT u.user_id, c.id AS content_id, row_number() OVER (PARTITION BY u.user_id ORDER BY round(h.s, 12) DESC, published_at DESC, c.id DESC) AS n FROM people u, (SELECT content_id, avg(score) AS s FROM content_halo WHERE halo_date >= CAST({NOW} AS DATE) - 14 GROUP BY content_id) h JOIN content c ON c.id = h.content_id WHERE published_at >= {NOW} - INTERVAL 14 DAY AND {_SPEAKS} AND {_BARRED.format(u='u.user_id', c='c.id')}",
    "b_evergreen": f"SELECT u.user_id, c.id AS content_id, row_number() OVER (PARTITION BY u.user_id ORDER BY curated_score DESC, source_rank ASC NULLS LAST, published_at DESC, c.id DESC) AS n FROM people u, curated k JOIN content c ON c.id = k.content_id WHERE curated_score > 0 AND {_SPEAKS} AND {_BARRED.format(u='u.user_id', c='c.id')}",
    "buckets": "SELECT user_id, content_id, bool_or(b = 1) AS subscribed, bool_or(b = 2) AS discovery, bool_or(b = 3) AS saved_adjacent, bool_or(b = 4) AS trending, bool_or(b = 5) AS evergreen FROM (SELECT *, 1 AS b FROM b_subscribed UNION ALL SELECT *, 2 FROM b_discovery UNION ALL SELECT *, 3 FROM b_adjacent UNION ALL SELECT *, 4 FROM b_trending UNION ALL SELECT *, 5 FROM b_evergreen) WHERE n <= 200 GROUP BY user_id, content_id",
    "matches": "SELECT user_id, content_id, max(w) AS topic_score, first(slug ORDER BY w DESC, slug) AS primary_topic_slug FROM (SELECT b.user_id, b.content_id, slug, greatest(score, 0e0) * confidence AS w FROM buckets b JOIN content_topics k ON k.content_id = b.content_id JOIN topic_affinity a ON a.user_id = b.user_id AND a.topic_id = k.topic_id JOIN topics t ON t.id = k.topic_id UNION ALL SELECT b.user_id, b.content_id, slug, greatest(score, 0e0) * confidence * 0.75e0 FROM buckets b JOIN content c ON c.id = b.content_id JOIN source_topics k ON k.source_id = c.source_id JOIN topic_affinity a ON a.user_id = b.user_id AND a.topic_id = k.topic_id JOIN topics t ON t.id = k.topic_id) GROUP BY user_id, content_id",
    "candidates": f"""SELECT b.*, c.source_id, c.language_code, c.published_at, coalesce(m.topic_score, 0e0) AS topic_score, coalesce(sa.score, 0e0) AS source_affinity_score, coalesce(ch.s, 0e0) AS content_halo_score, coalesce(sh.s, 0e0) AS source_halo_score, coalesce(s.editorial_score, 0e0) AS editorial_score, coalesce(k.curated_score, 0e0) AS curated_score, m.primary_topic_slug, coalesce(f.dismiss_count, 0) AS dismiss_count, coalesce(f.mark_read_count, 0) AS mark_read_count, coalesce(f.read_ratio, 0e0) AS read_ratio
        FROM buckets b JOIN content c ON c.id = b.content_id LEFT JOIN matches m USING (user_id, content_id) LEFT JOIN sources s ON s.id = c.source_id LEFT JOIN source_affinity sa ON sa.user_id = b.user_id AND sa.source_id = c.source_id
        LEFT JOIN (SELECT content_id, avg(score) AS s FROM content_halo WHERE halo_date >= CAST({NOW} AS DATE) - 30 GROUP BY content_id) ch ON ch.content_id = b.content_id
        LEFT JOIN (SELECT source_id, avg(score) AS s FROM source_halo WHERE halo_date >= CAST({NOW} AS DATE) - 30 GROUP BY source_id) sh ON sh.source_id = c.source_id
        LEFT JOIN curated k ON k.content_id = b.content_id LEFT JOIN feedback f ON f.user_id = b.user_id AND f.content_id = b.content_id""",
    "scored": f"""SELECT *, greatest(0.22e0*least(greatest(topic_score,0e0),2e0)/2 + 0.16e0*least(greatest(source_affinity_score,0e0),2e0)/2 + 0.10e0*content_halo_score + 0.07e0*source_halo_score + 0.08e0*editorial_score + 0.18e0*curated_score
        + 0.08e0*least(greatest((30e0 - greatest(floor(date_diff('microsecond', published_at, {NOW}) / 1e6) / 86400e0, 0e0)) / 30e0, 0e0), 1e0) + 0.08e0*boost + 0.03e0*(1 - boost) - CASE WHEN mark_read_count > 0 OR read_ratio >= 0.8e0 THEN 0.35e0 ELSE 0e0 END, 0e0) AS score
        FROM (SELECT c.*, CASE WHEN subscribed OR EXISTS (SELECT 1 FROM subscriptions s WHERE s.user_id = c.user_id AND s.source_id = c.source_id) THEN 1e0 ELSE 0e0 END AS boost FROM candidates c WHERE dismiss_count = 0)""",
    "engaged": "SELECT user_id, topic_id, max(score) AS affinity FROM source_affinity JOIN source_topics USING (source_id) WHERE score > 0 GROUP BY user_id, topic_id",
    "found": f"""SELECT DISTINCT user_id, source_id FROM (
        SELECT user_id, source_id, row_number() OVER (PARTITION BY user_id ORDER BY source_id) AS n FROM (SELECT DISTINCT user_id, source_id FROM topic_affinity JOIN source_topics USING (topic_id) WHERE score > 0)
        UNION ALL SELECT user_id, source_id, row_number() OVER (PARTITION BY user_id ORDER BY happened DESC, source_id) FROM (SELECT u.user_id, c.source_id, max(published_at) AS happened FROM people u, content c WHERE c.source_id IS NOT NULL AND published_at >= {NOW} - INTERVAL 30 DAY AND {_SPEAKS} AND NOT EXISTS (SELECT 1 FROM subscriptions x WHERE x.user_id = u.user_id AND x.source_id = c.source_id) GROUP BY u.user_id, c.source_id)
        UNION ALL SELECT user_id, source_id, row_number() OVER (PARTITION BY user_id ORDER BY source_id) FROM (SELECT DISTINCT e.user_id, t.source_id FROM engaged e JOIN source_topics t USING (topic_id) JOIN context x ON x.user_id = e.user_id WHERE NOT list_contains(x.top_sources, t.source_id))
        ) f WHERE n <= 200 AND NOT EXISTS (SELECT 1 FROM subscriptions s WHERE s.user_id = f.user_id AND s.source_id = f.source_id)""",
    "source_candidates": f"""SELECT f.user_id, f.source_id, coalesce(m.topic_score, 0e0) AS topic_score, m.primary_topic_slug, coalesce(h.s, 0e0) AS source_halo_score, coalesce(r.n, 0) AS recent_activity_count, coalesce(l.s, 0e0) AS similarity_score, s.editorial_score
        FROM found f JOIN sources s ON s.id = f.source_id
        LEFT JOIN (SELECT f.user_id, f.source_id, max(greatest(score, 0e0) * confidence) AS topic_score, first(slug ORDER BY greatest(score, 0e0) * confidence DESC, slug) AS primary_topic_slug FROM found f JOIN source_topics k USING (source_id) JOIN topic_affinity a ON a.user_id = f.user_id AND a.topic_id = k.topic_id JOIN topics t ON t.id = k.topic_id GROUP BY f.user_id, f.source_id) m ON m.user_id = f.user_id AND m.source_id = f.source_id
        LEFT JOIN (SELECT source_id, avg(score) AS s FROM source_halo WHERE halo_date >= CAST({NOW} AS DATE) - 30 GROUP BY source_id) h ON h.source_id = f.source_id
        LEFT JOIN (SELECT source_id, count(*) AS n FROM content WHERE published_at >= {NOW} - INTERVAL 30 DAY GROUP BY source_id) r ON r.source_id = f.source_id
        LEFT JOIN (SELECT f.user_id, f.source_id, avg(least(affinity * confidence, 2e0)) AS s FROM found f JOIN source_topics k USING (source_id) JOIN engaged e ON e.user_id = f.user_id AND e.topic_id = k.topic_id GROUP BY f.user_id, f.source_id) l ON l.user_id = f.user_id AND l.source_id = f.source_id""",
}


def over(body: str, **more: str) -> str:
    """body over the derived tables."""
    return "WITH " + ", ".join(f"{name} AS ({sql})" for name, sql in (TABLES | more).items()) + " " + body


def picks(rows: str, item: str, order: str, caps: dict[str, tuple[int, int]], limit: int = 20, early: int = 10) -> str:
    """The first picks under caps by key, then what was passed over, as a recursive walk down each user's ranking."""
    keys = ", ".join(f"CAST({k} AS VARCHAR) AS {k}" for k in caps)
    ranked = f"SELECT user_id, {item}, score, {keys}, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS n FROM {rows}"
    met = " AND ".join(f"(r.{k} IS NULL OR len(list_filter(w.{k}s, lambda x: x = r.{k})) < CASE WHEN len(w.picks) < {early} THEN {a} ELSE {b} END)" for k, (a, b) in caps.items())
    grown = ", ".join(f"CASE WHEN {met} THEN list_append(w.{k}s, r.{k}) ELSE w.{k}s END" for k in caps)
    none = ", ".join(f"CAST([] AS VARCHAR[]) AS {k}s" for k in caps)
    like = f"list_filter([r.{item}], lambda x: FALSE)"
    walk = f"""SELECT r.user_id, CAST(0 AS BIGINT) AS n, {like} AS picks, {like} AS passed, {none} FROM ranked r WHERE r.n = 1
        UNION ALL SELECT w.user_id, r.n, CASE WHEN {met} THEN list_append(w.picks, r.{item}) ELSE w.picks END, CASE WHEN {met} OR len(w.passed) >= {limit} THEN w.passed ELSE list_append(w.passed, r.{item}) END, {grown}
        FROM walk w JOIN ranked r ON r.user_id = w.user_id AND r.n = w.n + 1 WHERE len(w.picks) < {limit}"""
    body = f"""SELECT p.user_id, p.{item}, CAST(p.position AS INTEGER) AS position, round(r.score + 1e-9, 6) AS score FROM (
        SELECT user_id, unnest(row) AS {item}, unnest(range(len(row))) AS position FROM (SELECT user_id, list_concat(picks, passed)[1:{limit}] AS row FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC) AS back FROM walk) WHERE back = 1)) p JOIN ranked r ON r.user_id = p.user_id AND r.{item} = p.{item}"""
    return "WITH RECURSIVE " + over("").removeprefix("WITH ").rstrip() + f", ranked AS MATERIALIZED ({ranked}), walk AS ({walk}) " + body
