"""All oracle SQL strings, keyed like ``leadlens.plans.catalog.QUERIES``."""

from oracle import (sql_conversations, sql_identity, sql_leads, sql_metrics, sql_reports, sql_rubric,
                    sql_streams)

SQL: dict[str, str] = {}
for _m in (sql_metrics, sql_leads, sql_conversations, sql_reports, sql_identity, sql_streams, sql_rubric):
    SQL.update(_m.SQL)
