"""SQL forms of the adapters, for the checks in DuckDB."""

from __future__ import annotations

SERIES = "id, observatory"

VIEWS = {
    "timeseries": """
        SELECT concat('E', user_id) AS id,
               CASE WHEN event_type IN ('click', 'view') THEN 'L1' ELSE 'H1' END AS observatory,
               value AS size, ts AS capture_dttm
        FROM events""",
    "dense": """
        SELECT concat('E', event_id % 4) AS id,
               CASE WHEN event_id % 8 < 4 THEN 'L1' ELSE 'H1' END AS observatory,
               value AS size, make_timestamp(1584868278400000 + event_id * 3137) AS capture_dttm
        FROM events""",
    "features": """
        SELECT concat('GW', l_orderkey) AS commonName, l_linenumber AS version,
               l_quantity AS mass_1_source, nullif(l_discount, 0.0) AS mass_2_source,
               l_extendedprice / 1000 AS final_mass_source, l_shipdate AS merger_datetime
        FROM lineitem""",
    "event_ids": "SELECT concat('E', s_suppkey) AS id, s_name AS commonName FROM supplier",
    "event_names": """
        SELECT o_orderkey,
          CASE WHEN o_orderkey % 50 = 0 THEN 'blind_injection'
               WHEN o_orderkey % 50 = 1 THEN 'GW151012.2'
               WHEN o_orderkey % 10 = 2 THEN concat('GRB', strftime(o_orderdate, '%y%m%d'))
               WHEN o_orderkey % 10 = 3 THEN concat('GW', strftime(o_orderdate, '%y%m%d'))
               ELSE concat('GW', strftime(o_orderdate, '%y%m%d'), '_',
                           lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0'),
                           lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0'),
                           lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0')) END AS commonName
        FROM orders""",
    "strain": """
        SELECT vec_id AS event_id, CASE WHEN label = 0 THEN 'BNS' ELSE 'background' END AS target,
               CAST(i AS INTEGER) AS time_seq, CAST(embedding[i] AS DOUBLE) AS strain
        FROM embeddings, range(1, 65) r(i)""",
    "arrays": """
        SELECT vec_id AS event_id,
               list_concat(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), [CAST(label AS DOUBLE)]) AS vals
        FROM embeddings""",
    "bbh": """
        SELECT concat('GW', event_id) AS event,
               CASE WHEN event_id % 2 = 0 THEN 'L1' ELSE 'H1' END AS interferometer,
               time_seq, strain AS raw_value
        FROM strain""",
    "xprime4": None,
    "xprime8": None,
    "xprime16": None,
    # mean squared error per event at block 8
    "errors": """
        SELECT event_num, target, avg(pow(actual - pred, 2)) AS mean_mse, sum(pow(actual - pred, 2)) AS sum_mse
        FROM xprime8 GROUP BY event_num, target""",
    # errors with class code, flag and outcome; the outcomes are looked up in a table of the four cases
    "flagged": """
        SELECT * FROM (SELECT event_num, target, mean_mse, CAST(target <> 'background' AS INTEGER) AS target_binary,
                              CAST(mean_mse >= 0.0138::DOUBLE AND mean_mse <= 1 AS INTEGER) AS pred_binary FROM errors)
        NATURAL JOIN (VALUES (0, 0, 'tn'), (0, 1, 'fp'), (1, 0, 'fn'), (1, 1, 'tp'))
                     cases(target_binary, pred_binary, pred_category)""",
    # predictions of the three block sizes
    "sweep": """
        SELECT *, 16 AS latent_dims FROM xprime4
        UNION ALL SELECT *, 8 AS latent_dims FROM xprime8
        UNION ALL SELECT *, 4 AS latent_dims FROM xprime16""",
    # deciseconds, rounded: second and cell 0..10
    "ds_cells": """
        SELECT id, observatory, size, capture_dttm, date_trunc('second', capture_dttm) AS bucket,
               CAST(floor((floor((epoch_us(capture_dttm) % 1000000) / 1000) + 50) / 100) AS INTEGER) AS cell
        FROM dense""",
    "ds_means": """
        SELECT id, observatory, bucket, cell, avg(size) AS avg_size FROM ds_cells GROUP BY ALL""",
    "split": """
        SELECT event_id, CASE WHEN row_number() OVER (ORDER BY substr(md5(concat(event_id, '-23')), 1, 15), event_id)
                              <= ceil((SELECT count(*) FROM embeddings) * 0.1) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT DISTINCT vec_id AS event_id FROM embeddings)""",
    "positions": """
        SELECT *, row_number() OVER (PARTITION BY id, observatory ORDER BY capture_dttm) AS idx,
               count(*) OVER (PARTITION BY id, observatory) AS n
        FROM dense""",
    "chrono": """
        SELECT id, observatory, size, capture_dttm,
               CASE WHEN idx <= floor(n * 0.4::DOUBLE) THEN 'train' WHEN idx <= floor(n * 0.6::DOUBLE) THEN 'unused'
                    WHEN idx <= floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split
        FROM positions""",
}
for _block in (4, 8, 16):
    VIEWS[f"xprime{_block}"] = f"""
        SELECT event_id AS event_num, target, time_seq, strain AS actual,
               avg(strain) OVER (PARTITION BY event_id, floor((time_seq - 1) / {_block})) AS pred
        FROM strain"""

NEEDS = {
    "bbh": ["strain"],
    "xprime4": ["strain"],
    "xprime8": ["strain"],
    "xprime16": ["strain"],
    "errors": ["xprime8"],
    "flagged": ["errors"],
    "sweep": ["xprime4", "xprime8", "xprime16"],
    "ds_cells": ["dense"],
    "ds_means": ["ds_cells"],
    "positions": ["dense"],
    "chrono": ["positions"],
}


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` with the named views, and those they need, as common table expressions."""
    ordered: list[str] = []

    def add(view: str) -> None:
        for need in NEEDS.get(view, []):
            add(need)
        if view not in ordered:
            ordered.append(view)

    for view in views:
        add(view)
    parts = [f"{v} AS ({VIEWS[v]})" for v in ordered] + [f"{k} AS ({v})" for k, v in extra.items()]
    return (f"WITH {', '.join(parts)} " if parts else "") + body
