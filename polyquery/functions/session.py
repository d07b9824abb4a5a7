"""Session, metadata and stub functions: constants of the emulated server."""

from __future__ import annotations

from polyquery.functions.registry import FunctionCatalog

#: Values that a server would tell of itself.
CONSTANTS = {
    "DB_ID": "1", "SCHEMA_ID": "1", "SESSION_ID": "1", "SUSER_ID": "1", "USER_ID": "1", "XACT_STATE": "0", "CONNECTION_ID": "1", "CON_DBID_TO_ID": "1", "CON_GUID_TO_ID": "1", "CON_NAME_TO_ID": "1", "CON_UID_TO_ID": "1", "CURRENT_REQUEST_ID": "0", "CURRENT_TRANSACTION_ID": "1", "DATABASE_PRINCIPAL_ID": "1", "ORA_INVOKING_USERID": "1", "FILE_ID": "1", "FILE_IDEX": "1", "FILEGROUP_ID": "1", "ITERATION_NUMBER": "0", "DEPTH": "1", "SLEEP": "0", "BENCHMARK": "0",
    "DB_NAME": "current_database()", "DATABASE": "current_database()", "SCHEMA": "current_database()", "SCHEMA_NAME": "current_database()", "CURRENT_DATABASE": "current_database()", "CURRENT_SCHEMA": "current_database()", "ORIGINAL_DB_NAME": "current_database()", "CURRENT_SCHEMAS": "array(current_database())", "CURRENT_CATALOG": "current_catalog()",
    "USER_NAME": "current_user()", "CURRENT_USER": "current_user()", "SESSION_USER": "current_user()", "SYSTEM_USER": "current_user()", "SUSER_NAME": "current_user()", "SUSER_SNAME": "current_user()", "USER": "current_user()", "CURRENT_ROLE": "current_user()", "ORIGINAL_LOGIN": "current_user()", "ORA_INVOKING_USER": "current_user()",
    "VERSION": "version()", "SERVERPROPERTY": "version()", "APP_NAME": "'polyquery'", "HOST_NAME": "'localhost'", "HOST_ID": "'1'", "GETANSINULL": "1", "IS_MEMBER": "1", "IS_ROLEMEMBER": "1", "IS_SRVROLEMEMBER": "1", "HAS_PERMS_BY_NAME": "1", "APPLOCK_MODE": "'NoLock'", "APPLOCK_TEST": "1", "CURSOR_STATUS": "-3",
}
#: Functions that have nothing to tell without a server: NULL.
NOTHING = "SESSION_CONTEXT ASSEMBLYPROPERTY FILE_NAME FILEGROUP_NAME FILEGROUPPROPERTY FILEPROPERTY FULLTEXTCATALOGPROPERTY FULLTEXTSERVICEPROPERTY INDEX_COL INDEXKEY_PROPERTY INDEXPROPERTY MIN_ACTIVE_ROWVERSION OBJECT_DEFINITION STATS_DATE TYPEPROPERTY GET_FILESTREAM_TRANSACTION_CONTEXT CONNECTIONPROPERTY CONTEXT_INFO DATABASEPROPERTYEX COLUMNPROPERTY COL_LENGTH COL_NAME OBJECT_ID OBJECTPROPERTY OBJECTPROPERTYEX OBJECT_NAME OBJECT_SCHEMA_NAME SUSER_SID TYPE_ID TYPE_NAME ERROR_LINE ERROR_MESSAGE ERROR_NUMBER ERROR_PROCEDURE ERROR_SEVERITY ERROR_STATE WSREP_SYNC_WAIT_UPTO_GTID WSREP_LAST_SEEN_GTID WSREP_LAST_WRITTEN_GTID CURRENT_SETTING CURRENT_QUERY FEATURE_COMPARE FEATURE_DETAILS FEATURE_ID FEATURE_SET FEATURE_VALUE NCGR PREDICTION PREDICTION_BOUNDS PREDICTION_COST PREDICTION_DETAILS PREDICTION_PROBABILITY PREDICTION_SET PRESENTNNV PRESENTV CLUSTER_ID CLUSTER_PROBABILITY CLUSTER_SET CLUSTER_DETAILS CLUSTER_DISTANCE ORA_DST_AFFECTED ORA_DST_CONVERT ORA_DST_ERROR ORA_DM_PARTITION_NAME USERENV SYS_CONNECT_BY_PATH SYS_TYPEID SYS_CONTEXT NLS_CHARSET_DECL_LEN NLS_CHARSET_ID NLS_CHARSET_NAME NLS_COLLATION_NAME NLS_COLLATION_ID RDB$GET_CONTEXT RDB$SET_CONTEXT"
XML = "UPDATEXML EXISTSNODE XMLCAST XMLCDATA XMLCOLATTVAL XMLCOMMENT XMLCONCAT XMLDIFF XMLELEMENT XMLFOREST XMLPARSE XMLPATCH XMLPI XMLQUERY XMLROOT XMLSEQUENCE XMLSERIALIZE XMLTABLE XMLTRANSFORM XMLEXISTS XMLISVALID SYS_DBURIGEN SYS_XMLAGG SYS_XMLGEN CUBE_TABLE DATAOBJ_TO_PARTITION DATAOBJ_TO_MAT_PARTITION"


def define(c: FunctionCatalog) -> None:
    for name, value in CONSTANTS.items():
        c.add(name, value, kind="session")
    c.add(NOTHING, "null", kind="session")
    c.add(XML, "null", kind="session")
    c.add("EXTRACTVALUE", "null", kind="session")
    c.add("EXTRACTVALUE", "xpath_string({0}, {1})", "mysql", kind="session")
    # bound by the session: see polyquery.catalog
    c.add("FOUND_ROWS ROW_COUNT CHANGES ROWCOUNT ROWCOUNT_BIG SCOPE_IDENTITY LAST_INSERT_ID LASTVAL", "null", kind="bound")
    c.add("NEXTVAL CURRVAL SETVAL NEXT_VALUE_FOR PREVIOUS_VALUE_FOR GEN_ID", "null", kind="sequence")
