"""DuckDB SQL with the rows of glimmer.plans.queries, query by query."""

from __future__ import annotations


def r6(x: str) -> str:
    return f"round({x}, 6)"


def mean6(x: str) -> str:
    """A mean of figures with six places, of which halves are common: a billionth more decides them all alike."""
    return f"round({x} + 1e-9::DOUBLE, 6)"


def unit(x: str) -> str:
    """x scaled to the video's range."""
    over = "OVER (PARTITION BY video_id)"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x} - min({x}) {over}) / greatest(max({x}) {over} - min({x}) {over}, 1e-8::DOUBLE)))"


def clip(x: str, low: str = "0.0") -> str:
    return f"greatest({low}::DOUBLE, least(1.0::DOUBLE, {x}))"


#: Relations by name; each may use those before it.
PARTS: dict[str, str] = {
    "sig": "SELECT 'u' || user_id AS video_id, event_id, (epoch_us(ts::TIMESTAMP) - epoch_us(TIMESTAMP '2024-01-01'))::DOUBLE / 3600000000::DOUBLE AS time, value, event_type FROM events",
    "frames": "SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY time, event_id) - 1 AS frame_index, time, value FROM sig",
    "videos": "SELECT video_id, 25.0::DOUBLE AS fps, count(*) AS frame_count, ceil(max(time))::DOUBLE AS duration FROM sig GROUP BY video_id",
    "diffs": "SELECT * FROM (SELECT video_id, frame_index, time, abs(value - lag(value) OVER (PARTITION BY video_id ORDER BY frame_index)) AS value FROM frames) WHERE value IS NOT NULL",
    "secs": "SELECT video_id, floor(time)::BIGINT AS second, avg(value) AS value FROM diffs GROUP BY ALL",
    "grid": "SELECT video_id, slots, slot, slot::DOUBLE AS time FROM (SELECT video_id, floor(duration)::BIGINT + 1 AS slots, unnest(range(0, floor(duration)::BIGINT + 1)) AS slot FROM videos)",
    "dense": "SELECT g.video_id, g.slot AS second, coalesce(s.value, 0) AS value FROM grid g LEFT JOIN secs s ON g.video_id = s.video_id AND g.slot = s.second",
    "heat": f"""SELECT video_id, second, {r6('''CASE WHEN max(value) OVER w - min(value) OVER w > 1e-8
        THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) ELSE 0.0::DOUBLE END''')} AS value FROM dense WINDOW w AS (PARTITION BY video_id)""",
    "levels": "SELECT video_id, time, avg(value) AS rms FROM sig GROUP BY ALL",
    "scaled": f"SELECT video_id, time, {unit('rms')} AS l, {unit('(rms * rms)')} AS e FROM levels",
    "smooth": "SELECT video_id, time, sum(l) OVER w / 5.0::DOUBLE AS loudness, sum(e) OVER w / 5.0::DOUBLE AS energy FROM scaled WINDOW w AS (PARTITION BY video_id ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
    "feat": f"SELECT video_id, time, {r6('loudness')} AS loudness, {r6('energy')} AS energy, {r6('1 / (1 + exp(-(loudness - ' + clip('median(loudness) OVER (PARTITION BY video_id)') + ') / 0.15::DOUBLE))')} AS speech_probability FROM smooth",
    "loud": f"SELECT video_id, time, {r6(clip('0.6::DOUBLE * ' + unit('loudness') + ' + 0.4::DOUBLE * ' + unit('energy')))} AS score FROM feat",
    "dt": "SELECT video_id, greatest(coalesce(median(g), 0.1::DOUBLE), 1e-3::DOUBLE) AS dt FROM (SELECT video_id, time - lag(time) OVER (PARTITION BY video_id ORDER BY time) AS g FROM levels) GROUP BY video_id",
    "simple": "SELECT video_id, time, score FROM (SELECT *, lag(score) OVER w AS l, lead(score) OVER w AS r FROM loud WINDOW w AS (PARTITION BY video_id ORDER BY time)) WHERE score >= 0.6::DOUBLE AND score > l AND score >= r",
    "hist": "SELECT 'e' || floor(vec_id / 50)::BIGINT AS video_id, (vec_id % 50)::DOUBLE / 2 AS time, embedding::DOUBLE[] AS h FROM embeddings WHERE embedding IS NOT NULL",
    "hpairs": "SELECT * FROM (SELECT video_id, time, h, lag(h) OVER (PARTITION BY video_id ORDER BY time) AS p FROM hist) WHERE p IS NOT NULL",
    "hcent": "SELECT video_id, time, list_transform(h, lambda x: x - list_sum(h) / len(h)) AS a, list_transform(p, lambda x: x - list_sum(p) / len(p)) AS b FROM hpairs",
    "hscore": f"SELECT video_id, time, {r6(clip('1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b))'))} AS score FROM hcent",
    "hvideos": "SELECT video_id, max(time) + 0.5::DOUBLE AS duration FROM hist GROUP BY video_id",
    "shots": """SELECT video_id, 0.0::DOUBLE AS time FROM hscore GROUP BY video_id
      UNION SELECT s.video_id, min(c.time) FROM shots s JOIN hscore c ON s.video_id = c.video_id AND c.score >= 0.9::DOUBLE AND c.time - s.time >= 2.0::DOUBLE GROUP BY s.video_id, s.time""",
    "scenes": """SELECT * FROM (SELECT s.video_id, s.time AS "start", coalesce(lead(s.time) OVER (PARTITION BY s.video_id ORDER BY s.time), v.duration) AS "end" FROM shots s JOIN hvideos v ON s.video_id = v.video_id WHERE s.time > 0) WHERE "end" >= "start" """,
    "longer": """SELECT video_id, "start", "end" FROM (SELECT *, count(*) FILTER (WHERE "end" - "start" >= 3) OVER (PARTITION BY video_id) AS n FROM scenes) WHERE "end" - "start" >= 3 OR n = 0
      UNION ALL SELECT video_id, 0.0, 0.0 FROM hvideos v WHERE NOT EXISTS (FROM scenes s WHERE s.video_id = v.video_id)""",
    "zeroed": """SELECT * FROM longer UNION ALL SELECT video_id, 0.0, min("start") FROM longer GROUP BY video_id HAVING min("start") > 0""",
    "numbered": """SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY "start", "end") - 1)::INT AS index, "start", "end" FROM zeroed""",
    "turns": "SELECT 'c' || conv_id AS video_id, turn AS pos, coalesce(text, '') AS text, coalesce(length(text), 0) AS n, sum(coalesce(length(text), 0)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations",
    "seg": f"""SELECT video_id, pos, {r6('s')} AS "start", {r6('e')} AS "end", text FROM (SELECT video_id, pos, (upto - n)::DOUBLE / 15 AS s, upto::DOUBLE / 15 AS e, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM turns) WHERE length(text) > 0 AND e - s > 0.1::DOUBLE""",
    "sv": """SELECT video_id, max("end") AS duration FROM seg GROUP BY video_id""",
    "tiles": """SELECT video_id, block::INT AS block, block * 45.0::DOUBLE AS "start", least((block + 1) * 45.0::DOUBLE, duration) AS "end" FROM (SELECT *, unnest(range(0, ceil(duration / 45)::BIGINT)) AS block FROM sv)""",
    "held": """SELECT t.video_id, t.block, s.pos, s.text FROM seg s JOIN tiles t ON s.video_id = t.video_id AND floor(s."start" / 45)::INT = t.block AND s."start" >= t."start" AND s."end" <= t."end" """,
    "toks": "SELECT video_id, block, pos, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 1) AS k FROM held",
    "counted": "SELECT video_id, block, word, count(*) AS n, min(pos * 1000000 + k) AS first FROM toks WHERE regexp_full_match(word, '[a-z]+') AND length(word) > 2 AND word NOT IN ('the','and','for','from','that','this','with','are','was','what','how','where','when','why','which','you','not','but','his') GROUP BY ALL",
    "named": "SELECT video_id, block, string_agg(word, '_' ORDER BY n DESC, first) AS name FROM (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY video_id, block ORDER BY n DESC, first) <= 2) GROUP BY ALL",
    "topics": """SELECT t.video_id, t.block, t."start", t."end", CASE WHEN h.block IS NULL THEN 'silence' ELSE coalesce(n.name, 'general') END AS topic
      FROM tiles t LEFT JOIN (SELECT DISTINCT video_id, block FROM held) h ON t.video_id = h.video_id AND t.block = h.block LEFT JOIN named n ON t.video_id = n.video_id AND t.block = n.block""",
    "outs": """SELECT lang AS video_id, doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 0 THEN 'LABEL_0' WHEN doc_id % 5 = 0 THEN 'LABEL_1' WHEN doc_id % 7 = 0 THEN 'LABEL_2' ELSE 'POSITIVE' END AS label,
      (n_chars % 130)::DOUBLE / 100 AS confidence FROM documents JOIN labels USING (doc_id)""",
    "signed": f"""SELECT video_id, doc_id, CASE label WHEN 'POSITIVE' THEN c WHEN 'negative' THEN -c WHEN 'LABEL_2' THEN c WHEN 'LABEL_0' THEN -c ELSE 0 END AS score FROM (SELECT *, {clip('confidence')} AS c FROM outs)""",
    "funny": """SELECT video_id, pos, ("start" + "end") / 2 AS time, least(1.0::DOUBLE, 0.8::DOUBLE * contains(lower(text), 'explain')::INT + 0.8::DOUBLE * contains(lower(text), 'summar')::INT
      + 0.3::DOUBLE * contains(lower(text), 'the')::INT + 0.3::DOUBLE * contains(lower(text), 'and')::INT + 0.3::DOUBLE * contains(lower(text), 'please')::INT) AS score FROM seg""",
    "evs": "SELECT video_id, time, CASE WHEN event_type = 'error' THEN 'loud_event' ELSE 'laughter' END AS type FROM sig WHERE event_type IN ('error', 'signup') AND value > 150",
    "sizes": "SELECT DISTINCT video_id, slots FROM grid",
    "evflags": "SELECT video_id, slot, bool_or(type = 'laughter') AS has_laughter, bool_or(type = 'loud_event') AS has_loud_sound FROM (SELECT e.video_id, least(greatest(round_even(time, 0)::BIGINT, 0), slots - 1) AS slot, type FROM evs e JOIN sizes USING (video_id)) GROUP BY ALL",
    "marks": "SELECT video_id, time FROM sig WHERE event_type = 'purchase' AND value > 100",
    "mkflags": "SELECT DISTINCT m.video_id, least(greatest(round_even(time, 0)::BIGINT, 0), slots - 1) AS slot FROM marks m JOIN sizes USING (video_id)",
    "spans": """SELECT video_id, time AS "start", time + value / 10 AS "end" FROM sig WHERE event_type = 'view'""",
    "sweep": """SELECT video_id, slot, sum(d) AS d FROM (SELECT s.video_id, least(greatest(round_even("start", 0)::BIGINT, 0), slots - 1) AS slot, 1 AS d FROM spans s JOIN sizes USING (video_id) WHERE "end" > "start"
      UNION ALL SELECT s.video_id, least(greatest(round_even("end", 0)::BIGINT, 0), slots - 1) + 1, -1 FROM spans s JOIN sizes USING (video_id) WHERE "end" > "start") GROUP BY ALL""",
    "cover": "SELECT g.video_id, g.slot, sum(coalesce(d, 0)) OVER (PARTITION BY g.video_id ORDER BY g.slot) > 0 AS covered FROM grid g LEFT JOIN sweep s ON g.video_id = s.video_id AND g.slot = s.slot",
    "p_motion": "SELECT video_id, second::DOUBLE AS time, value FROM heat",
    "p_audio": "SELECT video_id, time, loudness AS value FROM feat",
    "p_speech": "SELECT video_id, time, speech_probability AS value FROM feat",
    "p_sent": f"SELECT video_id, time, {r6(clip('(value - 60) / 60', '-1.0'))} AS value FROM sig WHERE event_type = 'click'",
    "p_humor": f"SELECT video_id, time, {r6(clip('(value - 60) / 60'))} AS value FROM sig WHERE event_type = 'signup'",
    "p_high": "SELECT video_id, time, value FROM sig WHERE value > 100",
}


def _interpolated(points: str) -> str:
    return f"""SELECT video_id, slot, time, CASE WHEN coalesce(n, 0) = 0 THEN 0.0::DOUBLE WHEN n = 1 THEN m WHEN pt IS NULL OR qt IS NULL THEN 0.0::DOUBLE WHEN qt = pt THEN pv ELSE pv + (qv - pv) / (qt - pt) * (time - pt) END AS value
      FROM (SELECT video_id, slot, time, last_value(pt IGNORE NULLS) OVER b AS pt, last_value(pv IGNORE NULLS) OVER b AS pv, last_value(pt IGNORE NULLS) OVER a AS qt, last_value(pv IGNORE NULLS) OVER a AS qv,
                   count(pv) OVER (PARTITION BY video_id) AS n, max(pv) OVER (PARTITION BY video_id) AS m
            FROM (SELECT video_id, slot, time, NULL::DOUBLE AS pt, NULL::DOUBLE AS pv, 1 AS w FROM grid UNION ALL SELECT video_id, NULL, time, time, avg(value), 0 FROM {points} GROUP BY video_id, time)
            WINDOW b AS (PARTITION BY video_id ORDER BY time, w ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY video_id ORDER BY time DESC, w ROWS UNBOUNDED PRECEDING))
      WHERE slot IS NOT NULL"""


for _name in ("motion", "audio", "speech", "sent", "humor", "high"):
    PARTS[f"i_{_name}"] = _interpolated(f"p_{_name}")

# the five weights, divided by their sum of 1.2
_W = "0.4::DOUBLE / 1.2000000000000002::DOUBLE", "0.3::DOUBLE / 1.2000000000000002::DOUBLE", "0.2::DOUBLE / 1.2000000000000002::DOUBLE", "0.1::DOUBLE / 1.2000000000000002::DOUBLE", "0.2::DOUBLE / 1.2000000000000002::DOUBLE"
PARTS |= {
    "rows_": f"""SELECT video_id, slot, time, {unit('mv')} AS motion, {unit('av')} AS audio_loudness, sv AS sentiment, {clip('hv')} AS humor,
        coalesce(has_laughter, false) AS has_laughter, coalesce(has_loud_sound, false) AS has_loud_sound, k.slot2 IS NOT NULL AS is_scene_boundary,
        CASE WHEN max(pv) OVER (PARTITION BY video_id) > 0 THEN pv >= 0.5::DOUBLE ELSE covered END AS is_dialogue
      FROM (SELECT m.video_id, m.slot, m.time, m.value AS mv, a.value AS av, p.value AS pv, s.value AS sv, h.value AS hv FROM i_motion m JOIN i_audio a USING (video_id, slot) JOIN i_speech p USING (video_id, slot) JOIN i_sent s USING (video_id, slot) JOIN i_humor h USING (video_id, slot))
      LEFT JOIN evflags USING (video_id, slot) LEFT JOIN (SELECT video_id, slot, slot AS slot2 FROM mkflags) k USING (video_id, slot) LEFT JOIN cover USING (video_id, slot)
      WHERE video_id IN (SELECT video_id FROM videos WHERE duration > 0)""",
    "line": f"""SELECT video_id, slot, time, {r6(clip(f'''{_W[0]} * motion + {_W[1]} * audio_loudness + {_W[2]} * {clip('abs(sentiment)')} + {_W[3]} * humor
        + {_W[4]} * {clip('0.5::DOUBLE * has_laughter::INT + 0.3::DOUBLE * has_loud_sound::INT')}'''))} AS interest, {r6('motion')} AS motion, {r6('audio_loudness')} AS audio_loudness, {r6('sentiment')} AS sentiment, {r6('humor')} AS humor,
        has_laughter, has_loud_sound, is_scene_boundary, is_dialogue FROM rows_""",
    "quant": "SELECT video_id, quantile_cont(interest, 0.9) AS threshold, count(*) AS points FROM line GROUP BY video_id",
    "peaks": """SELECT video_id, time, interest FROM (SELECT *, lag(interest) OVER w AS l, lead(interest) OVER w AS r FROM line WINDOW w AS (PARTITION BY video_id ORDER BY time)) JOIN quant USING (video_id)
      WHERE points >= 3 AND interest >= threshold AND interest >= l AND interest >= r""",
    "lists": "SELECT video_id, list_sort(list(DISTINCT time)) AS marks FROM marks GROUP BY video_id",
    "placed": """SELECT video_id, peak, greatest(0.0::DOUBLE, e - 30) AS s, e, coalesce(marks, [0.0::DOUBLE]) AS marks FROM (SELECT p.video_id, p.time AS peak, least(v.duration, greatest(0.0::DOUBLE, p.time - 15) + 30) AS e FROM peaks p JOIN videos v USING (video_id)) LEFT JOIN lists USING (video_id)""",
}


def _near(t: str, marks: str = "marks") -> str:
    return f"list_min(list_transform({marks}, lambda b: {{'d': abs(b - {t}), 'b': b}})).b"


def _snap(t: str, test: str) -> str:
    return f"CASE WHEN abs({_near(t)} - {t}) {test} THEN {_near(t)} ELSE {t} END"


PARTS |= {
    "cand": f"""SELECT video_id, peak, {_snap('s', '<= 5')} AS "start", {_snap('e', '<= 5')} AS "end" FROM placed""",
    "scored": f"""SELECT c.video_id, c.peak, {r6('c."start"')} AS "start", {r6('c."end"')} AS "end", {mean6('coalesce(avg(l.interest), 0)')} AS score FROM cand c LEFT JOIN line l ON c.video_id = l.video_id AND l.time BETWEEN c."start" AND c."end" GROUP BY c.video_id, c.peak, c."start", c."end" """,
    "ranked": """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, peak, "start", "end") AS r FROM scored""",
}


def _greedy(name: str, top: int) -> dict[str, str]:
    return {
        f"fold{name}": f"""SELECT video_id, 0::BIGINT AS r, []::STRUCT(s DOUBLE, e DOUBLE, score DOUBLE)[] AS kept FROM (SELECT DISTINCT video_id FROM ranked{name})
          UNION ALL SELECT f.video_id, c.r, CASE WHEN len(f.kept) >= {top} OR len(list_filter(f.kept, lambda x: NOT (c."end" <= x.s OR c."start" >= x.e))) > 0 THEN f.kept
            ELSE list_append(f.kept, {{'s': c."start", 'e': c."end", 'score': c.score}}) END FROM fold{name} f JOIN ranked{name} c ON f.video_id = c.video_id AND c.r = f.r + 1""",
        f"kept{name}": f"""SELECT video_id, x.s AS "start", x.e AS "end", x.score AS score FROM (SELECT video_id, unnest(kept) AS x FROM fold{name} QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY r DESC) = 1)""",
    }


def _merge(name: str, gap: int) -> dict[str, str]:
    return {
        f"isl{name}": f"""SELECT *, sum((reach IS NULL OR "start" > reach + {gap})::INT) OVER (PARTITION BY video_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island
          FROM (SELECT *, max("end") OVER (PARTITION BY video_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM kept{name})""",
        f"grp{name}": f"""SELECT video_id, min("start") AS "start", max("end") AS "end", count(*) AS n, min(score) AS score FROM isl{name} GROUP BY video_id, island""",
        f"mrg{name}": f"""SELECT g.video_id, g."start", g."end", CASE WHEN g.n = 1 THEN g.score ELSE coalesce(avg(l.interest), 0) END AS score FROM grp{name} g LEFT JOIN line l ON g.video_id = l.video_id AND l.time BETWEEN g."start" AND g."end" GROUP BY g.video_id, g."start", g."end", g.n, g.score""",
    }


PARTS |= _greedy("", 6)
PARTS["ranked50"] = "SELECT * FROM ranked"
PARTS |= _greedy("50", 50) | _merge("50", 24)
# the chain without rounding in between
PARTS["rankedh"] = """SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, peak, "start", "end") AS r FROM (
  SELECT c.video_id, c.peak, c."start", c."end", coalesce(avg(l.interest), 0) AS score FROM cand c LEFT JOIN line l ON c.video_id = l.video_id AND l.time BETWEEN c."start" AND c."end" GROUP BY ALL)"""
PARTS |= _greedy("h", 6) | _merge("h", 3)
PARTS |= {
    "pauses": """SELECT video_id, list_sort(list(DISTINCT "start")) AS marks FROM seg WHERE pos % 2 = 1 GROUP BY video_id""",
    "snapt": f"""SELECT video_id, block, {_snap('s', '< 5')} AS s, {_snap('e', '< 5')} AS e, topic FROM (SELECT t.video_id, t.block, t."start" AS s, t."end" AS e, t.topic, coalesce(p.marks, [0.0::DOUBLE]) AS marks FROM topics t LEFT JOIN pauses p USING (video_id))""",
    "ord": "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY block) AS r FROM snapt",
    "absorb": """SELECT video_id, r, s, e, topic, 1 AS chapter FROM ord WHERE r = 1
      UNION ALL SELECT o.video_id, o.r, CASE WHEN a.e - a.s < 60 THEN a.s ELSE o.s END, o.e, CASE WHEN a.e - a.s < 60 THEN a.topic || '_' || o.topic ELSE o.topic END, CASE WHEN a.e - a.s < 60 THEN a.chapter ELSE a.chapter + 1 END
      FROM absorb a JOIN ord o ON a.video_id = o.video_id AND o.r = a.r + 1""",
    "chaps": """SELECT video_id, chapter::INT AS chapter, s AS "start", e AS "end", topic FROM absorb QUALIFY row_number() OVER (PARTITION BY video_id, chapter ORDER BY r DESC) = 1""",
    "talk": """SELECT video_id, "start" AS time, (length(text) % 64)::DOUBLE / 64 AS motion, (length(text) % 7)::DOUBLE / 8 AS humor, (length(text) % 16)::DOUBLE / 8 - 1 AS sentiment, length(text) % 3 = 0 AS is_dialogue FROM seg""",
    "stats": """SELECT c.video_id, c.chapter, c."start", c."end", c.topic, count(t.time) AS n, avg(motion) AS motion, avg(humor) AS humor, avg(abs(sentiment)) AS sentiment, bool_or(is_dialogue) AS dialogue
      FROM chaps c LEFT JOIN talk t ON c.video_id = t.video_id AND t.time BETWEEN c."start" AND c."end" GROUP BY ALL""",
    "runs": "SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY time) - 1 AS i FROM loud",
    "flat": "SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY video_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, (lag(score) OVER (PARTITION BY video_id ORDER BY time) <> score)::INT AS new FROM runs)",
    "tops": """SELECT video_id, floor((a + b) / 2)::BIGINT AS i, h FROM (SELECT *, lag(h) OVER w AS l, lead(h) OVER w AS r FROM (SELECT video_id, run, min(i) AS a, max(i) AS b, any_value(score) AS h FROM flat GROUP BY ALL) WINDOW w AS (PARTITION BY video_id ORDER BY run)) WHERE h > l AND h > r AND h >= 0.3::DOUBLE""",
    "topr": "SELECT t.video_id, t.i, t.h, greatest(1, floor(60 / dt)::INT) AS apart, row_number() OVER (PARTITION BY t.video_id ORDER BY t.h DESC, t.i DESC) AS r FROM tops t JOIN dt USING (video_id)",
    "topf": """SELECT video_id, 0::BIGINT AS r, []::BIGINT[] AS kept FROM (SELECT DISTINCT video_id FROM topr)
      UNION ALL SELECT f.video_id, t.r, CASE WHEN len(list_filter(f.kept, lambda x: abs(x - t.i) < t.apart)) > 0 THEN f.kept ELSE list_append(f.kept, t.i) END FROM topf f JOIN topr t ON f.video_id = t.video_id AND t.r = f.r + 1""",
    "topk": "SELECT video_id, unnest(kept) AS i FROM topf QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY r DESC) = 1",
    "wall": "SELECT k.video_id, k.i, p.score AS h, p.time, coalesce(max(s.i) FILTER (WHERE s.i < k.i AND s.score > p.score), -1) AS a, coalesce(min(s.i) FILTER (WHERE s.i > k.i AND s.score > p.score), 1000000000) AS b FROM topk k JOIN runs p ON k.video_id = p.video_id AND k.i = p.i JOIN runs s ON s.video_id = k.video_id GROUP BY k.video_id, k.i, p.score, p.time",
    "rise": "SELECT w.video_id, w.time, w.h, w.h - greatest(min(s.score) FILTER (WHERE s.i <= w.i), min(s.score) FILTER (WHERE s.i >= w.i)) AS rise FROM wall w JOIN runs s ON s.video_id = w.video_id AND s.i > w.a AND s.i < w.b GROUP BY w.video_id, w.i, w.time, w.h",
}


def sql(select: str, last: str) -> str:
    """select, after all parts up to `last`."""
    needed, todo = set(), [last, *[p for p in PARTS if f" {p}" in f" {select}"]]
    while todo:
        part = todo.pop()
        if part not in needed:
            needed.add(part)
            body = PARTS[part].replace("(", " ( ").replace(")", " ) ").replace(",", " ").split()
            todo += [p for p in PARTS if p in body and p not in needed]
    return "WITH RECURSIVE " + ",\n".join(f"{p} AS ({PARTS[p]})" for p in PARTS if p in needed) + f"\n{select}"


PARTS |= {
    "pix": "SELECT video_id, (time * 2)::BIGINT AS frame_index, time, list_transform(h, lambda x: floor(abs(x) * 100)::INT) AS px FROM hist",
    "pixpairs": "SELECT * FROM (SELECT *, lag(px) OVER (PARTITION BY video_id ORDER BY frame_index) AS before FROM pix) WHERE before IS NOT NULL",
    "ccuts": """SELECT video_id, 0.0::DOUBLE AS time FROM hscore GROUP BY video_id
      UNION SELECT s.video_id, min(c.time) FROM ccuts s JOIN hscore c ON s.video_id = c.video_id AND c.score >= 0.9::DOUBLE AND c.time - s.time >= 1.5::DOUBLE GROUP BY s.video_id, s.time""",
    "adapt": """SELECT video_id, time, score FROM (SELECT *, (sum(score) OVER w - score) / greatest(count(*) OVER w - 1, 1) AS around FROM hscore WINDOW w AS (PARTITION BY video_id ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
      WHERE score >= 0.5 AND (around <= 1e-5 OR score / around >= 1.02::DOUBLE)""",
    "acuts": """SELECT video_id, 0.0::DOUBLE AS time FROM hscore GROUP BY video_id
      UNION SELECT s.video_id, min(c.time) FROM acuts s JOIN adapt c ON s.video_id = c.video_id AND c.time - s.time >= 1.5::DOUBLE GROUP BY s.video_id, s.time""",
    "bytes3": "SELECT video_id, i // 216 AS frame_index, i % 216 AS k, ('0x' || substr(x, 2 * i + 1, 2))::INT AS v FROM (SELECT 'd' || doc_id AS video_id, hex(encode(text)) AS x, unnest(range(0, octet_length(encode(text)) // 216 * 216)) AS i FROM documents WHERE text IS NOT NULL)",
    "bgr": "SELECT video_id, frame_index, k // 3 // 12 AS y, k // 3 % 12 AS x, max(v) FILTER (k % 3 = 0) AS b, max(v) FILTER (k % 3 = 1) AS g, max(v) FILTER (k % 3 = 2) AS r FROM bytes3 GROUP BY ALL",
    "luma": "SELECT video_id, frame_index, y, x, (b * 3735 + g * 19235 + r * 9798 + 16384) >> 15 AS v FROM bgr",
    "taps": "SELECT o, s, greatest(0.0::DOUBLE, least(s + 1, (o + 1) * 1.5::DOUBLE) - greatest(s, o * 1.5::DOUBLE)) / 1.5::DOUBLE AS w FROM range(8) a(o), range(12) b(s) WHERE s < (o + 1) * 1.5 AND s + 1 > o * 1.5",
    "halved": "SELECT video_id, frame_index, y // 2 AS y, x // 2 AS x, round_even(sum(b) / 4, 0)::INT AS b, round_even(sum(g) / 4, 0)::INT AS g, round_even(sum(r) / 4, 0)::INT AS r FROM bgr GROUP BY ALL",
    "spread": "SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM halved",
    "hues": "SELECT *, ((CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END) * CASE WHEN d > 0 THEN round_even(30::DOUBLE * 4096 / d, 0)::INT ELSE 0 END + 2048)::DOUBLE / 4096 AS t, ((d * CASE WHEN v > 0 THEN round_even(255::DOUBLE * 4096 / v, 0)::INT ELSE 0 END + 2048) >> 12) AS s FROM spread",
    "hsv": "SELECT video_id, frame_index, floor(t)::INT + CASE WHEN floor(t) < 0 THEN 180 ELSE 0 END AS h, s, v FROM hues",
    "bins": "SELECT video_id, frame_index, c, bin, count(*) AS n FROM (SELECT video_id, frame_index, unnest([0, 1, 2]) AS c, unnest([h * 32 // 180, s * 32 // 256, v * 32 // 256]) AS bin FROM hsv) GROUP BY ALL",
    "colours": "SELECT video_id, frame_index, (c * 32 + bin)::INT AS bin, n / sqrt(sum(n * n) OVER (PARTITION BY video_id, frame_index, c)) AS value FROM bins",
    "colourpairs": "SELECT a.video_id, a.frame_index, sum(a.value) AS sx, sum(a.value * a.value) AS sxx FROM colours a GROUP BY ALL",
    "colourdots": "SELECT a.video_id, a.frame_index, sum(a.value * b.value) AS sxy FROM colours a JOIN colours b ON a.video_id = b.video_id AND a.frame_index = b.frame_index + 1 AND a.bin = b.bin GROUP BY ALL",
    "colourscore": f"""SELECT a.video_id, a.frame_index / 25::DOUBLE AS time, {r6(clip('1 - (coalesce(sxy, 0) - a.sx * b.sx / 96) / sqrt((a.sxx - a.sx * a.sx / 96) * (b.sxx - b.sx * b.sx / 96))'))} AS score
      FROM colourpairs a JOIN colourpairs b ON a.video_id = b.video_id AND a.frame_index = b.frame_index + 1 LEFT JOIN colourdots d ON d.video_id = a.video_id AND d.frame_index = a.frame_index""",
    "colourcuts": """SELECT video_id, 0.0::DOUBLE AS time FROM colourscore GROUP BY video_id
      UNION SELECT s.video_id, min(c.time) FROM colourcuts s JOIN colourscore c ON s.video_id = c.video_id AND c.score >= 0.35::DOUBLE AND c.time - s.time >= 0.2::DOUBLE GROUP BY s.video_id, s.time""",
    "marked": "SELECT video_id, frame_index, list_transform(range(72), lambda k: substr(hx, 2 * (72 * frame_index + k) + 1, 2) NOT IN ('00', '7F')) AS m FROM (SELECT 'd' || doc_id AS video_id, hex(encode(regexp_replace(text, '[aeiou ]', chr(127), 'g'))) AS hx, unnest(range(0, octet_length(encode(text)) // 72)) AS frame_index FROM documents WHERE text IS NOT NULL)",
    "worn": "SELECT video_id, frame_index, list_transform(range(72), lambda k: m[k + 1] AND (k % 12 = 0 OR m[k]) AND (k % 12 = 11 OR m[k + 2]) AND (k < 12 OR m[k - 11]) AND (k >= 60 OR m[k + 13])) AS m FROM marked",
    "grown": "SELECT video_id, frame_index, list_transform(range(72), lambda k: m[k + 1] OR (k % 12 > 0 AND m[k]) OR (k % 12 < 11 AND m[k + 2]) OR (k >= 12 AND m[k - 11]) OR (k < 60 AND m[k + 13])) AS m FROM worn",
    "bytes1": "SELECT video_id, i AS frame_index, substr(hx, 144 * i + 1, 144) AS hx FROM (SELECT 'd' || doc_id AS video_id, hex(encode(text)) AS hx, unnest(range(0, octet_length(encode(text)) // 72)) AS i FROM documents WHERE text IS NOT NULL)",
    "pixels1": "SELECT video_id, frame_index, k, ('0x' || substr(hx, 2 * k + 1, 2))::INT AS v FROM (SELECT video_id, frame_index, hx, unnest(range(0, 72)) AS k FROM bytes1)",
    "letters": "SELECT 'd' || doc_id AS video_id, i - 1 AS i, length(text) AS size, (unicode(substr(text, i, 1)) % 256 - 128) / 128::DOUBLE AS x FROM (SELECT doc_id, text, unnest(range(1, length(text) + 1)) AS i FROM documents)",
    "bank": """SELECT phase, k, w / sum(w) OVER (PARTITION BY phase) AS w FROM (
      SELECT phase, k, CASE WHEN abs(a) < 4 THEN CASE WHEN a = 0 THEN 1.0 ELSE sin(pi() * a) / (pi() * a) END * (0.5 + 0.5 * cos(pi() * a / 4)) ELSE 0 END AS w
      FROM (SELECT phase, k, (phase / 320::DOUBLE - k) * (16000 / 22050::DOUBLE) AS a FROM range(320) p(phase), range(-6, 8) t(k)))""",
    "resounds": """SELECT video_id, n, sum(x * w) AS y FROM (
      SELECT video_id, n, n * 22050 // 16000 + k AS i, w FROM (SELECT video_id, n, n * 22050 % 16000 // 50 AS phase FROM (
        SELECT video_id, unnest(range(0, (size * 16000 + 22049) // 22050)) AS n FROM (SELECT DISTINCT video_id, size FROM letters))) JOIN bank USING (phase) WHERE w <> 0) JOIN letters USING (video_id, i) GROUP BY ALL""",
    "power": "SELECT video_id, time, avg(value * value) AS v FROM sig WHERE event_type = 'view' GROUP BY ALL",
    "louds": "SELECT video_id, event_id, time, value FROM sig WHERE event_type <> 'view' AND video_id IN (SELECT video_id FROM power)",
    "resampled": """SELECT video_id, time, value AS loudness, CASE WHEN n = 1 THEN m WHEN pt IS NULL OR qt IS NULL THEN 0.0::DOUBLE WHEN qt = pt THEN pv ELSE pv + (qv - pv) / (qt - pt) * (time - pt) END AS energy
      FROM (SELECT video_id, event_id, time, value, last_value(pt IGNORE NULLS) OVER b AS pt, last_value(pv IGNORE NULLS) OVER b AS pv, last_value(pt IGNORE NULLS) OVER a AS qt, last_value(pv IGNORE NULLS) OVER a AS qv,
                   count(pv) OVER (PARTITION BY video_id) AS n, max(pv) OVER (PARTITION BY video_id) AS m
            FROM (SELECT video_id, event_id, time, value, NULL::DOUBLE AS pt, NULL::DOUBLE AS pv, 1 AS w FROM louds UNION ALL SELECT video_id, NULL, time, NULL, time, v, 0 FROM power)
            WINDOW b AS (PARTITION BY video_id ORDER BY time, w ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY video_id ORDER BY time DESC, w ROWS UNBOUNDED PRECEDING)) WHERE event_id IS NOT NULL""",
    "told": "SELECT video_id, slot, motion, audio_loudness, has_laughter, has_loud_sound, covered FROM rows_ JOIN cover USING (video_id, slot)",
}

_CHAPTER = """CASE WHEN contains(topic, '_') THEN array_to_string(string_split(topic, '_')[1:2], ' ') WHEN topic = 'silence' THEN 'Пауза' WHEN topic = 'general' THEN 'Общий контент' WHEN topic = 'intro' THEN 'Вступление'
  WHEN topic = 'dialog' THEN 'Диалог' WHEN topic = 'action' THEN 'Экшн' WHEN topic = 'comedy' THEN 'Комедия' ELSE upper(topic[1]) || lower(topic[2:]) END"""
_TOLD = "list_filter([CASE WHEN motion > 0.5 THEN 'высокая активность' END, CASE WHEN humor > 0.3 THEN 'юмористический контент' END, CASE WHEN sentiment > 0.4 THEN 'эмоциональные моменты' END, CASE WHEN dialogue THEN 'диалоги' END], lambda x: x IS NOT NULL)"

ORACLES: dict[str, str] = {
    "a1_second_mean": sql(f"SELECT video_id, floor(time)::BIGINT AS second, {r6('avg(value)')} AS value FROM sig GROUP BY ALL", "sig"),
    "a4_max_normalized_heatmap": sql(f"SELECT video_id, second, {r6('CASE WHEN max(value) OVER w > 0 THEN value / max(value) OVER w ELSE 0.0::DOUBLE END')} AS value FROM secs WINDOW w AS (PARTITION BY video_id)", "secs"),
    "a5_unit_range": sql(f"SELECT video_id, {r6('time')} AS time, {r6(unit('rms'))} AS value FROM levels", "levels"),
    "a6_motion_summary": sql(f"SELECT video_id, {r6('avg(value)')} AS mean, max(value) AS max, count(*) AS seconds FROM heat GROUP BY video_id", "heat"),
    "a11_shot_score": sql("SELECT video_id, time, score FROM hscore", "hscore"),
    "a12_window_rms": sql(f"SELECT video_id, frame, {r6('sqrt(avg(value * value))')} AS rms FROM (SELECT video_id, value, unnest(range(greatest(0, ceil((frame_index - 7)::DOUBLE / 4)::BIGINT), floor(frame_index::DOUBLE / 4)::BIGINT + 1)) AS frame FROM frames) GROUP BY ALL", "frames"),
    "a14_quantile": sql(f"SELECT video_id, {r6('threshold')} AS threshold, points FROM quant", "quant"),
    "a15_sampling_interval": sql(f"SELECT video_id, {r6('dt')} AS dt FROM dt", "dt"),
    "a16_scene_summary": sql(f"""SELECT video_id, count(*) AS count, {r6('avg(greatest(0.0, "end" - "start"))')} AS mean_length, max(greatest(0.0, "end" - "start"))::DOUBLE AS max_length FROM numbered GROUP BY video_id""", "numbered"),
    "a17_sentiment_summary": sql(f"SELECT video_id, {r6('avg(score)')} AS mean, {r6('max(abs(score))')} AS max_abs FROM signed GROUP BY video_id", "signed"),
    "a18_humor_summary": sql(f"SELECT video_id, {r6('avg(round(score, 6))')} AS mean, {r6('max(round(score, 6))')} AS max, count(*) FILTER (WHERE round(score, 6) > 0.5::DOUBLE) AS count_positive FROM funny GROUP BY video_id", "funny"),
    "a19_safe_mean": f"SELECT event_type AS video_id, {r6('coalesce(avg(value) FILTER (WHERE value > 50), 0)')} AS mean FROM events GROUP BY ALL",
    "a20_speech_summary": sql(f"""SELECT video_id, count(*) AS total_segments, length(string_agg(text, ' ' ORDER BY pos)) AS total_characters, {r6('sum("end" - "start")')} AS total_speech_duration FROM seg GROUP BY video_id""", "seg"),
    "a21_unique_topics": sql("SELECT video_id, count(*) AS total_segments, count(DISTINCT topic) AS unique_topics FROM topics GROUP BY video_id", "topics"),
    "a22_full_transcript": sql("SELECT video_id, string_agg(text, ' ' ORDER BY pos) AS transcript FROM seg GROUP BY video_id", "seg"),
    "a25_shot_summary": sql(f"SELECT video_id, {r6('avg(score)')} AS mean, {r6('max(score)')} AS max FROM hscore GROUP BY video_id", "hscore"),
    "f1_humor_score": sql(f"SELECT video_id, pos, round(time, 7) AS time, {r6('score')} AS score FROM funny", "funny"),
    "f2_rule_sentiment": sql("""SELECT video_id, round(("start" + "end") / 2, 7) AS time, 0.0::DOUBLE AS score FROM seg""", "seg"),
    "f3_k6_topics": sql(f"""SELECT video_id, block, {r6('"start"')} AS "start", {r6('"end"')} AS "end", topic FROM topics""", "topics"),
    "f4_loud_score": sql(f"SELECT video_id, {r6('time')} AS time, score FROM loud", "loud"),
    "f9_candidates": sql(f"""SELECT video_id, {r6('peak')} AS peak, {r6('"start"')} AS "start", {r6('"end"')} AS "end" FROM cand""", "cand"),
    "f10_f11_chapters": sql(f"""SELECT video_id, chapter, {r6('"start"')} AS "start", {r6('"end"')} AS "end", 'Глава ' || chapter || ': ' || {_CHAPTER} AS title,
      CASE WHEN n = 0 THEN 'Контент без особенностей' WHEN len({_TOLD}) > 0 THEN 'Сегмент с ' || array_to_string({_TOLD}, ', ') ELSE 'Спокойный контент' END AS description FROM stats""", "stats"),
    "highlights": sql(f"""SELECT video_id, {r6('"start"')} AS "start", {r6('"end"')} AS "end", 'top_interest' AS type, {mean6('score')} AS score FROM mrgh""", "mrgh"),
    "j1_a3_motion_heatmap": sql("SELECT video_id, second, value FROM heat", "heat"),
    "j2_interp_to_grid": sql(f"SELECT video_id, time, slot, {r6('value')} AS value FROM i_high", "i_high"),
    "j6_window_mean": sql("""SELECT video_id, peak, "start", "end", score FROM scored""", "scored"),
    "j8_event_flags": sql("SELECT video_id, slot, has_laughter, has_loud_sound FROM evflags", "evflags"),
    "j9_scene_flags": sql("SELECT video_id, slot, true AS is_scene_boundary FROM mkflags", "mkflags"),
    "j10_coverage": sql("SELECT video_id, slot, covered FROM cover", "cover"),
    "j11_fusion_timeline": sql("SELECT * FROM line", "line"),
    "j12_chapter_stats": sql(f"""SELECT video_id, chapter, {r6('"start"')} AS "start", {r6('"end"')} AS "end", n, {r6('motion')} AS motion, {r6('humor')} AS humor, {r6('sentiment')} AS sentiment, dialogue FROM stats""", "stats"),
    "k4_nms_topk": sql("""SELECT video_id, "start", "end", score FROM kept""", "kept"),
    "p1_frame_sampling_diff": sql(f"SELECT video_id, frame_index, {r6('time')} AS time, {r6('value')} AS value FROM (SELECT video_id, frame_index, time, abs(value - lag(value) OVER (PARTITION BY video_id ORDER BY frame_index)) AS value FROM frames WHERE frame_index % 3 = 0) WHERE value IS NOT NULL", "frames"),
    "p2_rate_sampling": sql(f"SELECT video_id, frame_index, {r6('time')} AS time, value FROM frames WHERE frame_index % 6 = 0", "frames"),
    "p5_transcript_filter": sql("""SELECT video_id, pos, "start", "end", text FROM seg""", "seg"),
    "p6_scene_filter": sql("""SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY "start", "end") - 1)::INT AS index, "start"::DOUBLE AS "start", "end"::DOUBLE AS "end" FROM longer""", "longer"),
    "p7_valid_points": f"SELECT user_id::VARCHAR AS video_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS time, {r6('value')} AS value FROM events WHERE value > 50 AND try_cast(json_extract_string(props, '$.k') AS DOUBLE) IS NOT NULL",
    "p8_usable_segments": sql("""SELECT video_id, pos, "start", CASE WHEN pos % 2 = 0 THEN "end" ELSE "start" END AS "end" FROM seg""", "seg"),
    "p10_label_score": sql(f"SELECT video_id, doc_id, {r6('score')} AS score FROM signed", "signed"),
    "s2_video_info": f"SELECT event_id::VARCHAR AS video_id, {r6('f')} AS fps, CASE WHEN n > 0 THEN n END AS frame_count, CASE WHEN n > 0 THEN {r6('n / f')} END AS duration, 1::BIGINT AS file_size_bytes FROM (SELECT event_id, CASE WHEN event_id % 3 = 2 AND round(value, 2) > 0 THEN round(value, 2) ELSE 25.0::DOUBLE END AS f, event_id % 100 - 10 AS n FROM events)",
    "s11_truncate": sql("""SELECT video_id, n > 3 AS truncated, n AS total_length, array_to_string(CASE WHEN n > 3 THEN x[1:1] ELSE x END, ',') AS first_items, CASE WHEN n > 3 THEN array_to_string(x[n - 1:n], ',') ELSE '' END AS last_items
      FROM (SELECT video_id, list(pos ORDER BY pos) AS x, count(*) AS n FROM seg GROUP BY video_id)""", "seg"),
    "u1_scene_boundaries": sql("""SELECT video_id, index, "start"::DOUBLE AS "start", "end"::DOUBLE AS "end" FROM numbered""", "numbered"),
    "w5_shot_boundaries": sql("SELECT video_id, time FROM shots", "shots"),
    "w6_adaptive_ratio": sql(f"""SELECT video_id, time, score AS value, {r6('CASE WHEN around > 1e-5 THEN least(score / around, 255.0::DOUBLE) WHEN score >= 0.5 THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END')} AS ratio
      FROM (SELECT *, (sum(score) OVER w - score) / greatest(count(*) OVER w - 1, 1) AS around FROM hscore WINDOW w AS (PARTITION BY video_id ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))""", "hscore"),
    "w7_smoothing_zero_pad": sql(f"SELECT video_id, {r6('time')} AS time, {r6('sum(rms) OVER (PARTITION BY video_id ORDER BY time ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0::DOUBLE')} AS value FROM levels", "levels"),
    "w8_speech_probability": sql(f"SELECT video_id, {r6('time')} AS time, loudness, energy, speech_probability FROM feat", "feat"),
    "w9_peaks_distance_prominence": sql(f"SELECT video_id, {r6('time')} AS time, h AS score FROM rise WHERE rise >= 0.15::DOUBLE", "rise"),
    "w10_peak_fallback": sql(f"SELECT video_id, {r6('time')} AS time, score FROM simple", "simple"),
    "w11_peak_extent": sql(f"""SELECT video_id, {r6('CASE WHEN r - l < 5 THEN greatest(0.0::DOUBLE, time - half) ELSE l END')} AS "start", {r6('CASE WHEN r - l < 5 THEN time + half ELSE r END')} AS "end", {r6('time')} AS time, 'loud_event' AS type, score AS confidence, score AS peak_value
      FROM (SELECT p.video_id, p.time, p.score, greatest(2.5::DOUBLE, d.dt) AS half, coalesce(max(s.time) FILTER (WHERE s.time < p.time AND s.score < 0.51::DOUBLE), min(s.time)) AS l, coalesce(min(s.time) FILTER (WHERE s.time > p.time AND s.score < 0.51::DOUBLE), max(s.time)) AS r
            FROM simple p JOIN loud s ON s.video_id = p.video_id JOIN dt d ON d.video_id = p.video_id GROUP BY p.video_id, p.time, p.score, d.dt)""", "simple"),
    "w12_interest_peaks": sql("SELECT video_id, time, interest FROM peaks", "peaks"),
    "w13_best_window": sql(f"""SELECT v.video_id, coalesce(b.t, 0.0) AS "start", coalesce(b.t + 24, least(v.duration, 24.0)) AS "end", {r6('coalesce(b.score, 0)')} AS score FROM videos v LEFT JOIN (
      SELECT video_id, max({{'score': score, 'k': -t}}).score AS score, -max({{'score': score, 'k': -t}}).k AS t FROM (
        SELECT h.video_id, h.t, avg(h.value) OVER (PARTITION BY h.video_id ORDER BY h.t RANGE BETWEEN CURRENT ROW AND 24 FOLLOWING) AS score FROM (SELECT video_id, second::DOUBLE AS t, floor(value * 64) / 64 AS value FROM heat) h) JOIN videos USING (video_id) WHERE t + 24 <= duration GROUP BY video_id) b USING (video_id)""", "heat"),
    "w16_j5_topic_blocks": sql("SELECT video_id, block, pos FROM held", "held"),
    "w17_merge": sql(f"""SELECT video_id, "start", "end", {mean6('score')} AS score FROM mrg50""", "mrg50"),
    "w18_absorb_short": sql(f"""SELECT video_id, chapter, {r6('"start"')} AS "start", {r6('"end"')} AS "end", topic FROM chaps""", "chaps"),
    "a7_pixel_difference": sql(f"SELECT video_id, frame_index, time, {r6('list_sum(list_transform(list_zip(px, before), lambda z: abs(z[1] - z[2])))::DOUBLE / len(px)')} AS value FROM pixpairs", "pixpairs"),
    "a8_moving_fraction": sql(f"SELECT video_id, frame_index, {r6('CASE WHEN list_max(px) > 0 THEN len(list_filter(px, lambda x: x::DOUBLE / list_max(px) > 0.3::DOUBLE))::DOUBLE / len(px) ELSE 0.0::DOUBLE END')} AS value FROM pix", "pix"),
    "f8_covered_dialogue": sql(f"""SELECT video_id, slot, coalesce(covered, false) AS is_dialogue, {r6(clip("0.4::DOUBLE * motion + 0.3::DOUBLE * audio_loudness + 0.2::DOUBLE * " + clip("0.5::DOUBLE * has_laughter::INT + 0.3::DOUBLE * has_loud_sound::INT")))} AS interest FROM told""", "told"),
    "f9_unsnapped": sql(f"""SELECT video_id, peak, {r6('s')} AS "start", {r6('e')} AS "end" FROM placed""", "placed"),
    "f12_document": sql(f"""SELECT v.video_id, round(v.duration, 4) AS duration, s.transcript, s.positions, s.texts, round(s.sum_of_starts, 4) AS sum_of_starts, t.topics, c.titles, round(c.chapter_seconds, 4) AS chapter_seconds
      FROM sv v JOIN (SELECT video_id, string_agg(text, ' ' ORDER BY pos) AS transcript, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions, string_agg(text, '|' ORDER BY pos) AS texts, sum("start") AS sum_of_starts FROM seg GROUP BY video_id) s USING (video_id)
      JOIN (SELECT video_id, string_agg(topic, '|' ORDER BY block) AS topics FROM topics GROUP BY video_id) t USING (video_id)
      JOIN (SELECT video_id, string_agg('Глава ' || chapter || ': ' || {_CHAPTER}, '|' ORDER BY chapter) AS titles, sum({r6('"end"')} - {r6('"start"')}) AS chapter_seconds FROM stats GROUP BY video_id) c USING (video_id)""", "stats"),
    "j13_energy_on_loudness": sql("SELECT video_id, round(time, 4) AS time, loudness, round(energy, 4) AS energy FROM resampled", "resampled"),
    "j14_zipped_points": sql("""SELECT video_id, a.t AS time, b.pos AS value FROM (SELECT video_id, "start" AS t, row_number() OVER (PARTITION BY video_id ORDER BY "start") AS i FROM seg) a JOIN (SELECT video_id, pos, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS i FROM seg WHERE pos % 3 <> 2) b USING (video_id, i)""", "seg"),
    "k2_time_order": sql("SELECT video_id, pos, floor(time / 20)::DOUBLE AS time, row_number() OVER (PARTITION BY video_id ORDER BY floor(time / 20), pos)::INT AS place FROM funny", "funny"),
    "p11_scene_starts": sql("""SELECT DISTINCT video_id, "start"::DOUBLE AS time FROM numbered""", "numbered"),
    "p15_score_or_sentiment": sql(f"SELECT video_id, {r6('time')} AS time, {r6('CASE WHEN event_id % 2 = 0 THEN value ELSE value / 2 END')} AS value FROM sig WHERE event_id % 2 = 1 OR value > 100", "sig"),
    "w6_adaptive_cuts": sql("SELECT video_id, time FROM acuts", "acuts"),
    "p3_grey_resized": sql("""SELECT video_id, frame_index, 8 AS width, 4 AS height, string_agg(format('{:02X}', v), '' ORDER BY y, x) AS pixels FROM (
      SELECT video_id, frame_index, a.o AS y, b.o AS x, round_even(sum(v * a.w * b.w), 0)::INT AS v FROM luma JOIN taps a ON a.s = y JOIN taps b ON b.s = x WHERE a.o < 4 GROUP BY ALL) GROUP BY video_id, frame_index""", "luma"),
    "a9_opened_fraction": sql(f"SELECT video_id, frame_index, {r6('len(list_filter(m, lambda x: x)) / 72::DOUBLE')} AS value FROM grown", "grown"),
    "a10_colour_histogram": sql(f"SELECT video_id, frame_index, bin, {r6('value')} AS value FROM colours", "colours"),
    "w4_colour_scores": sql("SELECT video_id, time, score FROM colourscore", "colourscore"),
    "w5_colour_cuts": sql("SELECT video_id, time FROM colourcuts", "colourcuts"),
    "s4_frame_scan": sql("SELECT video_id, frame_index, 12 AS width, 6 AS height, hx AS pixels FROM bytes1 WHERE frame_index >= 3 AND frame_index % 3 = 0", "bytes1"),
    "s5_scan_differences": sql(f"SELECT b.video_id, b.frame_index, {r6('avg(abs(b.v - a.v))')} AS value FROM pixels1 a JOIN pixels1 b ON a.video_id = b.video_id AND a.k = b.k AND b.frame_index = a.frame_index + 2 WHERE b.frame_index % 2 = 0 GROUP BY b.video_id, b.frame_index", "pixels1"),
    "s6_resampled_levels": sql(f"SELECT video_id, frame, {r6('sqrt(avg(y * y))')} AS rms FROM (SELECT video_id, y, unnest(range(greatest(0, n // 800 - 1), n // 800 + 1)) AS frame FROM resounds) GROUP BY ALL", "resounds"),
    "w6_content_cuts": sql("SELECT video_id, time FROM ccuts", "ccuts"),
}
for _key, _test in (("j3_snap_inclusive", "<= 5"), ("j4_snap_strict", "< 5")):
    ORACLES[_key] = sql(f"""SELECT video_id, event_id, {_snap('t', _test)} AS snapped, {_near('t')} AS near FROM (SELECT video_id, event_id, floor(time)::DOUBLE AS t FROM sig)
      JOIN (SELECT video_id, list_sort(list(DISTINCT floor(time)::DOUBLE)) AS marks FROM marks GROUP BY video_id) USING (video_id)""", "marks")
