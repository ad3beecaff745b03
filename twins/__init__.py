"""One SQL query per operator, on the same Parquet files."""


def all_sql() -> dict[str, str]:
    from twins import actions, composites, kpi, others, rules, sales, titles

    return {**kpi.QUERIES, **sales.QUERIES, **titles.QUERIES, **rules.QUERIES, **actions.QUERIES, **others.QUERIES, **composites.QUERIES}
