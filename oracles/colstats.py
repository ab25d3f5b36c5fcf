from fleetstat.plans import colstats as C
from oracles.sqltext import NOW, clock, latest, older, pct, pretty

COLS = """(SELECT *, nullif(len(most_common_vals), 0) AS mcv_count, nullif(len(histogram_bounds), 0) AS histogram_buckets
    FROM column_stats WHERE schemaname NOT IN ('information_schema', 'pg_catalog')) x"""
HOURS = f"((epoch_us({NOW}) - epoch_us({latest('last_analyze', 'last_autoanalyze')})) // 3600000000)"
CHANGES = "(n_tup_ins + n_tup_upd + n_tup_del)"
SUMMARY = f"""(SELECT t.server_id, stale, never, coalesce(weak, 0) AS weak, m.setting::BIGINT AS target FROM
    (SELECT server_id, count(*) FILTER ({older(latest('last_analyze', 'last_autoanalyze'), 604800)} AND n_live_tup > 10000) AS stale,
            count(*) FILTER (last_analyze IS NULL AND last_autoanalyze IS NULL AND n_live_tup > 1000) AS never
     FROM table_stats GROUP BY server_id) t
    LEFT JOIN (SELECT server_id, count(*) FILTER (n_distinct > 1000 AND mcv_count < 10) AS weak FROM {COLS} GROUP BY server_id) c
      ON c.server_id = t.server_id
    LEFT JOIN settings m ON m.server_id = t.server_id AND m.name = 'default_statistics_target') z"""

# Column types of the profiled tables, needed for widths.
WIDTH = {
    "orders": {"o_orderkey": 8, "o_custkey": 8, "o_orderstatus": 0, "o_totalprice": 8, "o_orderdate": 8, "o_orderpriority": 0},
    "lineitem": {"l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8, "l_extendedprice": 8,
                 "l_discount": 8, "l_tax": 8, "l_returnflag": 0, "l_linestatus": 0, "l_shipdate": 8},
    "customer": {"c_custkey": 8, "c_name": 0, "c_nationkey": 4, "c_acctbal": 8, "c_mktsegment": 0},
    "part": {"p_partkey": 8, "p_name": 0, "p_brand": 0, "p_type": 0, "p_size": 4, "p_retailprice": 8},
    "events": {"event_id": 8, "ts": 8, "user_id": 8, "event_type": 0, "value": 8, "props": 0},
    "documents": {"doc_id": 8, "text": 0, "lang": 0, "source": 0, "n_chars": 8},
}


def profile(table: str) -> str:
    branches = []
    for c, w in WIDTH[table].items():
        width = f"avg(strlen({c}))" if w == 0 else f"CASE WHEN count({c}) > 0 THEN {w}.0::DOUBLE END"
        branches.append(f"""
            SELECT '{table}' AS table_name, '{c}' AS attname, count(*) AS row_count,
                   (count(*) - count({c}))::DOUBLE / count(*)::DOUBLE AS null_frac,
                   (CASE WHEN count({c}) > 0 AND count(DISTINCT {c}) = count({c}) THEN -1 ELSE count(DISTINCT {c}) END)::BIGINT AS n_distinct,
                   {width} AS avg_width,
                   coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) g), 0)::BIGINT AS top_frequency,
                   coalesce((SELECT count(*) FROM (SELECT count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c}) g WHERE n > 1), 0)::BIGINT AS repeated_values
            FROM {table}""")
    return " UNION ALL ".join(branches)


FLOATS = {"o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "c_acctbal", "p_retailprice", "value"}
TIMES = {"o_orderdate", "l_shipdate", "ts"}
ORDER = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "events": ["event_id"], "lineitem": ["l_orderkey", "l_linenumber"]}
WHOLE = {"embeddings": ["vec_id", "label"]}
NESTED = {
    "events": ["""SELECT 'props.' || key AS attname, json_extract_string(props, '$."' || key || '"') AS text, NULL::DOUBLE AS number,
                  strlen(json_extract_string(props, '$."' || key || '"'))::BIGINT AS width FROM (SELECT props, unnest(json_keys(props)) AS key FROM events)"""],
    "embeddings": ["SELECT 'embedding.size' AS attname, len(embedding)::VARCHAR AS text, len(embedding)::DOUBLE AS number, 4::BIGINT AS width FROM embeddings",
                   "SELECT 'embedding[]' AS attname, NULL::VARCHAR AS text, x::DOUBLE AS number, CASE WHEN x IS NOT NULL THEN 4::BIGINT END AS width"
                   " FROM (SELECT unnest(embedding) AS x FROM embeddings)"],
}


def cell(c: str, text: bool) -> str:
    if text:
        return f"{c} AS text, NULL::DOUBLE AS number"
    if c in FLOATS:
        return f"NULL::VARCHAR AS text, {c}::DOUBLE AS number"
    return f"{c}::VARCHAR AS text, {f'epoch_us({c})' if c in TIMES else c}::DOUBLE AS number"


def cells(table: str, extra: str = "", source: str = "", json: bool = False) -> str:
    columns = WIDTH.get(table) or dict.fromkeys(WHOLE[table], 4)
    parts = [f"SELECT '{c}' AS attname, {cell(c, w == 0)}{extra} FROM {source or table}" for c, w in columns.items() if not (json and c == "props")]
    parts += [f"SELECT attname, text, number FROM ({p})" for p in NESTED.get(table, ()) if json]
    return " UNION ALL ".join(parts)


def common(table: str, k: int = 10) -> str:
    return f"""SELECT '{table}' AS table_name, attname, rank, value, number, freq FROM (
        SELECT *, row_number() OVER (PARTITION BY attname ORDER BY freq DESC, number NULLS FIRST, value)::INT AS rank FROM (
            SELECT attname, CASE WHEN length(text) > 32 THEN 'md5:' || md5(text) ELSE text END AS value, number, count(*) AS freq
            FROM ({cells(table, json=True)}) c WHERE text IS NOT NULL OR number IS NOT NULL GROUP BY ALL) f) r WHERE rank <= {k}"""


def bounds(table: str, buckets: int = 10) -> str:
    return f"""SELECT '{table}' AS table_name, attname, j::INT AS bucket, text AS bound_text, number AS bound_number FROM (
        SELECT *, row_number() OVER (PARTITION BY attname ORDER BY number NULLS FIRST, text) AS place, count(*) OVER (PARTITION BY attname) AS n
        FROM ({cells(table)}) c WHERE text IS NOT NULL OR number IS NOT NULL) r JOIN range({buckets + 1}) t(j) ON place = 1 + (j * (n - 1)) // {buckets}"""


def correlations(table: str) -> str:
    order = ORDER[table] + [c for c in WIDTH[table] if c not in ORDER[table]]
    placed = f"(SELECT *, row_number() OVER (ORDER BY {', '.join(c + ' NULLS FIRST' for c in order)}) AS position FROM {table})"
    return f"""SELECT '{table}' AS table_name, attname, count(*) AS value_count, round(corr(position::DOUBLE, place::DOUBLE), 6) AS correlation FROM (
        SELECT *, row_number() OVER (PARTITION BY attname ORDER BY number NULLS FIRST, text, position) AS place
        FROM ({cells(table, ', position', placed)}) c WHERE text IS NOT NULL OR number IS NOT NULL) r GROUP BY attname"""


def nested(table: str) -> str:
    return f"""
        SELECT '{table}' AS table_name, attname, sum(n)::BIGINT AS cell_count, coalesce(sum(n) FILTER (void), 0)::DOUBLE / sum(n)::DOUBLE AS null_frac,
               (CASE WHEN max(n) FILTER (NOT void) = 1 THEN -1 ELSE count(*) FILTER (NOT void) END)::BIGINT AS n_distinct,
               sum(bytes)::DOUBLE / sum(n) FILTER (NOT void)::DOUBLE AS avg_width,
               coalesce(max(n) FILTER (NOT void), 0)::BIGINT AS top_frequency, count(*) FILTER (NOT void AND n > 1) AS repeated_values
        FROM (SELECT attname, text, number, text IS NULL AND number IS NULL AS void, count(*) AS n, sum(width) AS bytes
              FROM ({' UNION ALL '.join(NESTED[table])}) c GROUP BY ALL) g GROUP BY attname"""


def statistics(table: str) -> str:
    return f"""SELECT p.*, mcv_count, histogram_buckets, correlation FROM ({profile(table)}) p
        LEFT JOIN (SELECT attname, count(*) AS mcv_count FROM ({common(table, 100)}) WHERE freq > 1 GROUP BY attname) m ON m.attname = p.attname
        LEFT JOIN (SELECT attname, count(DISTINCT coalesce(bound_text, bound_number::VARCHAR)) AS histogram_buckets FROM ({bounds(table, 100)}) GROUP BY attname) b
          ON b.attname = p.attname
        LEFT JOIN ({correlations(table)}) r ON r.attname = p.attname"""


def line(category: str, text: str) -> str:
    return f"SELECT server_id, '{C.ADVICE_TITLES[category]}' AS category, {text} AS recommendation FROM {SUMMARY}"


SQL = {
    "sc1_statistics_settings": f"""SELECT server_id, name, setting, unit, short_desc FROM settings
        WHERE name IN ({', '.join(f"'{n}'" for n in C.STATISTICS_SETTINGS)})""",
    "sc2_custom_targets": f"""SELECT server_id, schemaname, table_name, attname AS column_name, attstattarget AS statistics_target,
        CASE WHEN attstattarget = 0 THEN 'No statistics' ELSE attstattarget::VARCHAR END AS target_description
        FROM {COLS} WHERE attstattarget <> -1""",
    "sc3_insufficient_stats": f"""SELECT x.server_id, schemaname, table_name, attname AS column_name, n_distinct,
        array_to_string(most_common_vals, ',') AS most_common_vals, mcv_count, histogram_buckets, correlation,
        {C.STATISTICS_QUALITY.sql()} AS statistics_quality, m.setting AS default_target
        FROM {COLS} LEFT JOIN settings m ON m.server_id = x.server_id AND m.name = 'default_statistics_target'
        WHERE ({C.WEAK_MCV}) OR ({C.WEAK_HISTOGRAM}) OR ({C.WEAK_CORRELATION})""",
    "sc4_stats_freshness": f"""SELECT server_id, schemaname, table_name, n_live_tup, n_dead_tup, {CHANGES} AS total_changes_since_analyze,
        {clock('last_analyze')} AS last_analyze, {clock('last_autoanalyze')} AS last_autoanalyze,
        {clock('most_recent_analyze')} AS most_recent_analyze, {HOURS} AS hours_since_analyze, statistics_age,
        {pct(CHANGES, 'n_live_tup')} AS change_percentage
        FROM (SELECT *, {C.STATISTICS_AGE.sql()} AS statistics_age
              FROM (SELECT *, greatest(last_analyze, last_autoanalyze) AS most_recent_analyze FROM table_stats) y) z WHERE n_live_tup > 1000""",
    "sc5_column_distribution": f"""SELECT server_id, schemaname, table_name, attname, null_frac, n_distinct, avg_width,
        {C.NULL_CATEGORY.sql()} AS null_category, {C.CARDINALITY_CATEGORY.sql()} AS cardinality_category,
        {C.SIZE_CATEGORY.sql()} AS size_category FROM {COLS} WHERE {C.NOTABLE}""",
    "sc6_index_efficiency": f"""SELECT server_id, schemaname, table_name, index_name, idx_scan AS scans, idx_tup_read AS tuples_read,
        idx_tup_fetch AS tuples_fetched, {pretty('index_size')} AS index_size, {C.USAGE_CATEGORY.sql()} AS usage_category,
        {C.EFFICIENCY.sql()} AS efficiency_rating FROM index_stats WHERE index_size > 1048576""",
    "sc7_table_stats_issues": f"""SELECT *, {C.ISSUE_TYPE.sql()} AS issue_type, {C.ISSUE_ADVICE.sql()} AS recommendation FROM (
        SELECT c.*, n_live_tup AS row_count, {HOURS} AS hours_since_analyze FROM (
            SELECT server_id, schemaname, table_name, count(*) FILTER (n_distinct > 1000 AND mcv_count < 10) AS high_cardinality_low_mcv,
                   count(*) FILTER (null_frac > 0.3) AS high_null_columns,
                   count(*) FILTER (abs(correlation) > 0.5) AS high_correlation_columns, count(*) AS total_columns
            FROM {COLS} GROUP BY ALL) c
        LEFT JOIN table_stats t ON t.server_id = c.server_id AND t.schemaname = c.schemaname AND t.table_name = c.table_name) w
        WHERE high_cardinality_low_mcv > 0 OR high_correlation_columns > 0.5 * total_columns
           OR high_null_columns > 0.3 * total_columns OR (hours_since_analyze > 168 AND row_count > 100000)""",
    "sc8_extended_stats": f"""SELECT e.server_id, e.schemaname AS schema_name, e.table_name, stxname AS statistics_name,
        array_to_string(stxkeys, ',') AS column_positions,
        {C.STATISTICS_KIND.sql().replace('first_kind', 'stxkind[1]')} AS statistics_type, {pretty('total_relation_size')} AS table_size
        FROM ext_stats e LEFT JOIN table_stats t ON t.server_id = e.server_id AND t.relid = e.relid""",
    "sc9_statistics_advice": " UNION ALL ".join([
        line("immediate", """CASE WHEN never > 0 THEN 'ANALYZE ' || never || ' tables that have never been analyzed'
             ELSE 'All tables have been analyzed at least once' END"""),
        line("regular", """CASE WHEN stale > 0 THEN 'Update statistics on ' || stale || ' large tables with stale statistics'
             ELSE 'Large table statistics are current' END"""),
        line("tuning", """CASE WHEN weak > 0 THEN 'Consider increasing statistics_target for ' || weak || ' high-cardinality columns'
             ELSE 'Column statistics targets appear adequate' END"""),
        line("configuration", """CASE WHEN target < 100 THEN 'Consider increasing default_statistics_target (current: ' || target || ', recommend: 100-1000)'
             WHEN target > 1000 THEN 'default_statistics_target is high (' || target || ') - ensure ANALYZE performance is acceptable'
             ELSE 'default_statistics_target (' || target || ') appears reasonable' END"""),
    ]),
    **{f"a16_{t}_column_profile": profile(t) for t in WIDTH},
    **{f"a16m_{t}_most_common_values": common(t) for t in (*WIDTH, "embeddings")},
    **{f"a16h_{t}_histogram_bounds": bounds(t) for t in ORDER},
    **{f"a16c_{t}_order_correlation": correlations(t) for t in ORDER},
    **{f"a16n_{t}_nested_profile": nested(t) for t in NESTED},
    "sc3c_insufficient_computed_stats": f"""SELECT table_name, attname AS column_name, n_distinct, mcv_count, histogram_buckets, correlation,
        CASE WHEN n_distinct > 100 AND mcv_count < 10 THEN 'LOW_MCV_COUNT' WHEN n_distinct > 1000 AND histogram_buckets < 20 THEN 'LOW_HISTOGRAM_RESOLUTION'
             ELSE 'POOR_CORRELATION_STATS' END AS statistics_quality
        FROM ({statistics('orders')} UNION ALL {statistics('customer')}) s
        WHERE (n_distinct > 100 AND mcv_count < 10) OR (n_distinct > 1000 AND histogram_buckets < 20) OR (abs(correlation) > 0.1 AND histogram_buckets < 50)""",
    "sc5c_computed_distribution": f"""SELECT table_name, attname, null_frac, n_distinct, avg_width,
        CASE WHEN null_frac > 0.5 THEN 'HIGH_NULLS' WHEN null_frac > 0.1 THEN 'MODERATE_NULLS' WHEN null_frac > 0 THEN 'LOW_NULLS' ELSE 'NO_NULLS' END AS null_category,
        CASE WHEN n_distinct = -1 THEN 'UNIQUE' WHEN n_distinct > 1000 THEN 'HIGH_CARDINALITY' WHEN n_distinct > 100 THEN 'MODERATE_CARDINALITY'
             WHEN n_distinct > 10 THEN 'LOW_CARDINALITY' ELSE 'VERY_LOW_CARDINALITY' END AS cardinality_category,
        CASE WHEN avg_width > 1000 THEN 'LARGE_VALUES' WHEN avg_width > 100 THEN 'MEDIUM_VALUES' ELSE 'SMALL_VALUES' END AS size_category
        FROM ({' UNION ALL '.join(profile(t) for t in WIDTH)}) p
        WHERE null_frac > 0.5 OR n_distinct = -1 OR n_distinct > 1000 OR avg_width > 100""",
}
