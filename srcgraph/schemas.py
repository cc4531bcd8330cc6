"""Record shapes of the graph, the event log and recorded model answers."""

from __future__ import annotations

from pyspark.sql import types as T

# The events that end a session.
TERMINAL_KINDS = ("analysis:complete", "error")

FIELD = "struct<name:string,type:string,nullable:boolean>"

# One nullable struct per node kind, so that a query touching one kind reads one column group.
METADATA_VARIANTS = {
    "service": ("Service", "struct<name:string,language:string,framework:string,file_path:string>"),
    "api": (
        "ApiEndpoint",
        "struct<method:string,path:string,handler_name:string,auth_required:boolean,"
        "middlewares:array<string>,file_path:string,line_number:int>",
    ),
    "database": (
        "DatabaseEntity",
        f"struct<name:string,db_type:string,orm:string,fields:array<{FIELD}>,file_path:string>",
    ),
    "external": (
        "ExternalDependency",
        "struct<name:string,category:string,env_keys:array<string>,sdk_package:string>",
    ),
    "feature": ("Feature", "struct<name:string,route:string,file_path:string,uses_auth:boolean>"),
}
METADATA = (
    "struct<type:string,"
    + ",".join(f"{name}:{ddl}" for name, (_, ddl) in METADATA_VARIANTS.items())
    + ">"
)

NODE_COLUMNS = (
    "session_id", "source_rank", "ord", "sub", "id", "type", "label", "confidence",
    "agent_source", "metadata",
)
EDGE_COLUMNS = (
    "session_id", "source_rank", "ord", "sub", "id", "source", "target", "type", "label",
    "animated", "relationship_type", "direction",
)

# Element shapes of the JSON arrays that recorded answers carry, by agent.
# Numbers and booleans stay strings here: one badly typed field must not void its record.
ANSWER_SHAPES = {
    "api": "struct<method:string,path:string,handlerName:string,authRequired:string,middlewares:array<string>>",
    "data": "struct<name:string,dbType:string,orm:string,"
            "fields:array<struct<name:string,type:string,nullable:string>>>",
    "service": "struct<name:string,filePath:string,description:string,dependsOn:array<string>>",
    "infra": "struct<name:string,category:string,envKeys:array<string>,sdkPackage:string>",
    "features": "struct<name:string,route:string,filePath:string,usesAuth:string,"
                "usesServices:array<string>,confidence:string>",
}
PLAN_SHAPE = (
    "struct<entryPoints:array<string>,routeFiles:array<string>,"
    "modelFiles:array<string>,configFiles:array<string>>"
)
VERDICT_SHAPE = "struct<keep:array<string>,remove:array<string>>"

# Payload shape of each event kind on the log.
EVENT_PAYLOADS = {
    "agent:update": "struct<agentName:string,status:string,message:string>",
    "node:added": "struct<id:string,type:string,data:struct<label:string,confidence:double,agentSource:string>>",
    "edge:added": "struct<id:string,source:string,target:string,type:string,label:string,animated:boolean,"
                  "data:struct<relationshipType:string,direction:string>>",
    "node:updated": "struct<id:string,data:struct<label:string,confidence:double,agentSource:string>>",
    "analysis:complete": "struct<sessionId:string>",
    "error": "struct<message:string,agentName:string>",
}

SOURCE_FILES = T.StructType([
    T.StructField("repo_id", T.StringType(), False),
    T.StructField("ord", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("content", T.BinaryType(), True),
])

EVENT_LOG = "session_id bigint, seq bigint, ts timestamp, event string, data string"
