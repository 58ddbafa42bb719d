"""Fixed values that must equal the reference's for equal results.

They are stated once, plainly, in the order the reference lists them.
"""

# Raw object types that become one node type.
TABLE_LIKE_TYPES = ("TABLE", "VIEW", "PATH", "STREAMING_TABLE", "EXTERNAL", "MANAGED")
TABLE_NODE_TYPE = "TABLE/VIEW/PATH"
# Other type renames (raw type -> node type).
DASHBOARD_TYPES = ("DBSQL_DASHBOARD", "DASHBOARD_V3")
DASHBOARD_NODE_TYPE = "DASHBOARD"
QUERY_TYPE = "DBSQL_QUERY"
QUERY_NODE_TYPE = "QUERY"
JOB_TYPES = ("JOB", "PIPELINE")
JOB_NODE_TYPE = "JOB/PIPELINE"

# URL path after "https://<host>" per raw entity type.
ENTITY_URL_PATHS = (
    ("NOTEBOOK", "/#notebook/"),
    ("PIPELINE", "/pipelines/"),
    ("JOB", "/jobs/"),
    ("DBSQL_QUERY", "/editor/queries/uuid/"),
    ("DASHBOARD_V3", "/sql/dashboardsv3/"),
    ("DBSQL_DASHBOARD", "/sql/dashboards/"),
)
EXPLORE_PATH = "/explore/data/"

# Lineage source tags.
UC_TAG = "table_lineage"
HMS_TAG = "hms_table_lineage"

# Operational catalog and schema excluded from the graph.
SYSTEM_CATALOG = "system"
INFO_SCHEMA = "information_schema"

# Audit actions that delete an asset, and the two matched by LIKE.
DELETE_ACTIONS = (
    "deleteTable",
    "deleteJob",
    "deletePipeline",
    "deleteNotebook",
    "deleteDashboard",
    "deleteQuery",
    "deleteQueryDraft",
    "deleteSchema",
    "delete",
)
LIKE_DELETE_ACTIONS = ("deleteSchema", "deleteDashboard")
# Where a deletion of a non-table asset points, per audit action:
# the URL path after "https://<host>" and the request parameter holding the id.
# The dashboard path is a LIKE pattern covering both dashboard URL forms, and
# "delete" counts only when it comes from the jobs service.
DELETE_URL_PATHS = (
    ("delete", "/jobs/", "job_id"),
    ("deletePipeline", "/pipelines/", "pipelineId"),
    ("deleteNotebook", "/#notebook/", "notebookId"),
    ("deleteDashboard", "/sql/dashboards%/", "dashboardId"),
    ("deleteQuery", "/editor/queries/uuid/", "queryId"),
    ("deleteQueryDraft", "/editor/queries/uuid/", "queryId"),
)
JOBS_SERVICE = "jobs"
# The two exact dashboard URL forms (strict mode matches these).
DASHBOARD_URL_FORMS = ("/sql/dashboards/", "/sql/dashboardsv3/")

# Fixed value: last_altered stamped on legacy tables (Python's datetime.max).
LEGACY_LAST_ALTERED = "9999-12-31 23:59:59.999999"

# Levels shown by default on selection, and suggestions listed.
DEFAULT_LEVELS = 3
SUGGESTIONS = 5
