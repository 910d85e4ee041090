"""DuckDB SQL twins of the fixtures (for the oracle check).

The same rules as ``fixtures.py`` written as SQL text over the pre-registered
views (lineitem, orders, customer, documents, labels, embeddings, events).
"""

from __future__ import annotations

from featurelab.plans import fixtures as fx


def qi(name: str) -> str:
    return '"' + name + '"'


def metrics_long(entity: str = "l_suppkey") -> str:
    return (f"SELECT {entity} AS entity, l_returnflag || l_linestatus AS variant, "
            "CASE WHEN l_tax < 0.05 THEN 'default' ELSE 'tuned' END AS hparam_source, "
            "l_linenumber AS fold, l_extendedprice * (1 - l_discount) AS metric FROM lineitem")


RAW_FEATURE_SQL = {
    "f__gen.general.nr_inst": "CAST(count(*) AS DOUBLE)",
    "f__gen.general.nr_cust": "CAST(count(DISTINCT o_custkey) AS DOUBLE)",
    "f__gen.line.quantity.mean": "((CAST(sum(CAST(round((l_quantity) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(l_quantity) AS DOUBLE))",
    "f__gen.line.quantity.sum": "(CAST(sum(CAST(round((l_quantity) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0)",
    "f__gen.line.quantity.sd": "stddev_pop(l_quantity)",
    "f__gen.line.price.mean": "((CAST(sum(CAST(round((l_extendedprice) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(l_extendedprice) AS DOUBLE))",
    "f__gen.line.price.sum": "(CAST(sum(CAST(round((l_extendedprice) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0)",
    "f__gen.line.peak.max": "max(l_extendedprice * l_quantity) / 4.8",
    "f__gen.line.discount.mean": "((CAST(sum(CAST(round((l_discount) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(l_discount) AS DOUBLE))",
    "f__gen.line.tax.mean": "((CAST(sum(CAST(round((l_tax) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(l_tax) AS DOUBLE))",
    "f__gen.line.return.share": "((CAST(sum(CAST(round((CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS DOUBLE))",
    "f__gen.line.return.share.relative": "((CAST(sum(CAST(round((CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS DOUBLE)) * 2.0",
    "f__gen.order.total.mean": "((CAST(sum(CAST(round((o_totalprice) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(o_totalprice) AS DOUBLE))",
    "f__gen.order.urgent.share": "((CAST(sum(CAST(round((CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS DOUBLE))",
    "f__gen.customer.balance.mean": "((CAST(sum(CAST(round((c_acctbal) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(c_acctbal) AS DOUBLE))",
    "f__gen.customer.building.share": "((CAST(sum(CAST(round((CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS DOUBLE))",
    "f__gen.const.flag.value": "max(1.0::DOUBLE)",
    "f__gen.dup.quantity.mean": "((CAST(sum(CAST(round((l_quantity) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(l_quantity) AS DOUBLE))",
    "f__gen.sparse.bulk.mean": "((CAST(sum(CAST(round((CASE WHEN l_quantity >= 50 AND l_discount >= 0.1 THEN l_quantity END) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(CASE WHEN l_quantity >= 50 AND l_discount >= 0.1 THEN l_quantity END) AS DOUBLE))",
    "f__gen.partial.bulk.mean": "((CAST(sum(CAST(round((CASE WHEN l_quantity >= 49 THEN l_quantity END) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(CASE WHEN l_quantity >= 49 THEN l_quantity END) AS DOUBLE))",
    "f__gen.debug.line.mean": "((CAST(sum(CAST(round((CAST(l_linenumber AS DOUBLE)) * 100.0) AS BIGINT)) AS DOUBLE) / 100.0) / CAST(count(CAST(l_linenumber AS DOUBLE)) AS DOUBLE))",
    "misc_tax_max": "max(l_tax)",
}
assert list(RAW_FEATURE_SQL) == fx.RAW_FEATURES


def entity_features_raw() -> str:
    cols = ", ".join(f"{e} AS {qi(n)}" for n, e in RAW_FEATURE_SQL.items())
    return ("SELECT l_suppkey AS entity, l_linenumber AS fold, " + cols +
            " FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
            " GROUP BY l_suppkey, l_linenumber")


def median(x: str) -> str:
    """Median as Spark computes it: the middle value, or (a + b) / 2 of the two middles."""
    lst = f"list_sort(list({x}) FILTER (WHERE {x} IS NOT NULL))"
    cnt = f"count({x})"
    return f"(({lst})[({cnt} + 1) // 2] + ({lst})[({cnt} + 2) // 2]) / 2"


def collapsed(agg: str = "median") -> str:
    fn = median if agg == "median" else (lambda x: f"{agg}({x})")
    cols = ", ".join(f"{fn(qi(n))} AS {qi(n)}" for n in fx.RAW_FEATURES)
    return f"SELECT entity, {cols} FROM ({entity_features_raw()}) r WHERE entity IS NOT NULL GROUP BY entity"


def long_of(table: str, features: list[str], pos: bool = False) -> str:
    names = ", ".join(f"'{f}'" for f in features)
    vals = ", ".join(f"CAST({qi(f)} AS DOUBLE)" for f in features)
    poss = ", ".join(str(i) for i in range(len(features)))
    extra = f", unnest([{poss}]) AS pos" if pos else ""
    return (f"SELECT entity, unnest([{names}]) AS feature, unnest([{vals}]) AS value{extra} FROM {table}")


def doc_features() -> str:
    def share(pat: str) -> str:
        return (f"CAST(length(text) - length(regexp_replace(text, '{pat}', '', 'g')) AS DOUBLE)"
                " / CAST(greatest(length(text), 1) AS DOUBLE)")
    return ("SELECT d.doc_id AS entity, ln(1 + CAST(length(text) AS DOUBLE)) AS f_log_chars, "
            f"{share(' ')} AS f_space, {share(chr(10))} AS f_newline, {share('[0-9]')} AS f_digit, "
            f"{share('[A-Z]')} AS f_upper, {share('[.]')} AS f_dot, "
            "CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic "
            "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


def wide_matrix() -> str:
    cols = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {fx.WIDE_FEATURES[i]}" for i in range(fx.N_EMBED))
    return f"SELECT vec_id AS entity, {cols}, CAST(label AS INTEGER) AS label FROM embeddings"
