"""Common table expressions that the archive queries' SQL starts with."""

from __future__ import annotations

FRAME, VOLUME = 65_536, 500_000

#: files; cat: the catalog; offs: places of unique bytes; fr0: frames; fr: frames of an archive without packing (mode raw);
#: vol, fv: their volumes; sl: slices; attr: columns that documents lack; ent: catalog rows with all that is known of them.
CTE = f"""
files AS (
  SELECT doc_id, source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.txt' AS path_rel,
    CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, coalesce(text, '') AS text FROM documents),
cat AS (
  SELECT path_rel, size, size > 0 AND r > 1 AS is_duplicate, CASE WHEN size > 0 AND r > 1 THEN orig END AS original_path
  FROM (
    SELECT path_rel, size, row_number() OVER w AS r, first_value(path_rel) OVER w AS orig
    FROM files WINDOW w AS (PARTITION BY size, md5(text) ORDER BY lower(path_rel), path_rel))),
offs AS (
  SELECT path_rel, size, CAST(coalesce(sum(size) OVER (
    ORDER BY lower(path_rel), path_rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM cat WHERE NOT is_duplicate),
tot AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS total FROM offs),
fr0 AS (
  SELECT frame_id, frame_id * {FRAME} AS frame_start, least(frame_id * {FRAME} + {FRAME}, total) AS frame_end
  FROM tot, unnest(range(0, (total + {FRAME} - 1) // {FRAME})) AS u(frame_id)),
fr AS (SELECT *, frame_end - frame_start AS original_size, 'raw' AS mode, frame_end - frame_start AS size FROM fr0),
fold(frame_id, size, volume_no, volume_offset, used) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT fr.frame_id, fr.size, CASE WHEN used > 0 AND used + fr.size > {VOLUME} THEN volume_no + 1 ELSE volume_no END,
    CASE WHEN used > 0 AND used + fr.size > {VOLUME} THEN 0 ELSE used END,
    CASE WHEN used > 0 AND used + fr.size > {VOLUME} THEN fr.size ELSE used + fr.size END
  FROM fold JOIN fr ON fr.frame_id = fold.frame_id + 1),
vol AS (SELECT frame_id, size, volume_no, volume_offset FROM fold WHERE frame_id >= 0),
fv AS (SELECT fr.*, vol.volume_no, vol.volume_offset FROM fr JOIN vol USING (frame_id)),
sl AS (
  SELECT path_rel, frame_id, greatest(start, frame_start) - start AS in_file, greatest(start, frame_start) - frame_start AS in_frame,
    least(start + size, frame_end) - greatest(start, frame_start) AS length
  FROM offs JOIN fr0 ON frame_end > start AND frame_start < start + size WHERE size > 0),
attr AS (
  SELECT doc_id, CAST(doc_id * 37 % 4096 AS INT) AS attrs, doc_id * 86399.0::DOUBLE + 1.5e9 AS mtime, doc_id % 3 = 0 AS flag,
    CASE WHEN doc_id % 7 <> 0 THEN doc_id * doc_id * 4099 END AS size, source || '-' || lang AS sddl FROM documents),
ent AS (
  SELECT c.path_rel, c.size, c.is_duplicate, c.original_path, o.start,
    CASE WHEN o.size > 0 THEN o.start // {FRAME} END AS frame_id,
    CASE WHEN o.size > 0 THEN 'archive.' || lpad(CAST(volume_no AS VARCHAR), 3, '0') END AS volume_name,
    CASE WHEN is_duplicate THEN 0 ELSE c.size END AS compressed_size, a.attrs, a.mtime, a.sddl
  FROM cat c JOIN files f ON f.path_rel = c.path_rel JOIN attr a ON a.doc_id = f.doc_id
  LEFT JOIN offs o ON o.path_rel = coalesce(c.original_path, c.path_rel)
  LEFT JOIN vol ON vol.frame_id = CASE WHEN o.size > 0 THEN o.start // {FRAME} END),
dups AS (SELECT original_path, count(*) AS n FROM cat WHERE is_duplicate GROUP BY 1),
bytes AS (SELECT string_agg(hex(encode(text)), '' ORDER BY lower(path_rel), path_rel) AS h FROM files JOIN offs USING (path_rel)),
frame_digests AS (
  SELECT frame_id, sha256(unhex(substr(h, CAST(frame_start * 2 + 1 AS BIGINT), CAST((frame_end - frame_start) * 2 AS BIGINT)))) AS digest
  FROM fr0, bytes),
talk AS (
  SELECT string_agg(hex(encode(coalesce(text, ''))), '' ORDER BY conv_id, turn, md5(coalesce(text, ''))) AS h FROM conversations),
talk_frames AS (
  SELECT frame_id, CAST(least(4096, strlen(h) // 2 - frame_id * 4096) AS BIGINT) AS size,
    sha256(unhex(substr(h, CAST(frame_id * 8192 + 1 AS BIGINT), 8192))) AS digest
  FROM talk, unnest(range(0, CAST((strlen(h) // 2 + 4095) // 4096 AS BIGINT))) AS u(frame_id))
"""


def next_fit(items: str, limit: int) -> str:
    """A fold of a query's rows (frame_id, size), numbered from 0, into volumes of ``limit`` bytes, as a common table expression."""
    new = f"used > 0 AND used + i.size > {limit}"
    return f""", items AS MATERIALIZED ({items}),
own(frame_id, size, volume_no, volume_offset, used) AS (
  SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT i.frame_id, i.size, CASE WHEN {new} THEN volume_no + 1 ELSE volume_no END, CASE WHEN {new} THEN 0 ELSE used END,
    CASE WHEN {new} THEN i.size ELSE used + i.size END
  FROM own JOIN items i ON i.frame_id = own.frame_id + 1)"""


def bytes_text(size: str, n: int) -> str:
    units = ["KB", "MB", "GB"]
    out = f"CASE WHEN {size} < 1024 THEN printf('%.{n}f B', {size}::DOUBLE)"
    for i, unit in enumerate(units, 1):
        head = f" WHEN {size} < {1024 ** (i + 1)} THEN" if i < len(units) else " ELSE"
        out += f"{head} printf('%.{n}f {unit}', {size} / {1024**i}.0::DOUBLE)"
    return out + " END"
