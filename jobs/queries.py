"""The registered queries of the jobs."""

from __future__ import annotations

from . import index_refresh, site_audit

QUERIES = {"job1_index_refresh": index_refresh.registered, "job2_site_audit": site_audit.registered}
ORACLE_SQL = {"job1_index_refresh": index_refresh.ORACLE_SQL, "job2_site_audit": site_audit.ORACLE_SQL}
