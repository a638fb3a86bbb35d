"""Record shapes and vocabularies of the flow model.

NULL is the only form of "absent": the parsers turn empty strings and zero counters into NULL.
"""

from __future__ import annotations

# Layers in causal order, providers by layer, and the action vocabulary.
LAYERS = ("edge", "bot_management", "app_firewall", "origin")
PROVIDERS = {"cloudflare": "edge", "datadome": "bot_management", "f5asm": "app_firewall", "nginx": "origin"}
ACTIONS = ("allowed", "logged", "rate_limited", "challenged", "challenge_passed", "challenge_failed", "blocked", "unknown")
TERMINAL_ACTIONS = ("blocked", "challenge_failed", "rate_limited")
CACHE_SERVED = ("hit", "revalidated", "updating", "stale")
UNKNOWN_LAYER = 99

EVENT = """
schema_version string, event_id string, raw_id string, tenant string, provider string, dataset string, parser_version string,
identifiers array<string>, correlation_key string, correlation_key_source string, ray_id string, vendor_request_id string,
event_time timestamp, received_at timestamp, clock_skew_ms bigint, time_quality string, layer string, layer_ord int,
client struct<ip:string,asn:bigint,country:string,user_agent:string>,
request struct<method:string,host:string,path:string,query:string,headers:map<string,string>>,
response struct<status:int,bytes:bigint,duration_ms:double,cache_status:string>,
verdict struct<action:string,terminating:boolean,rule_id:string,rule_name:string,category:string,score:double,reason_raw:string,mapped:boolean>,
bot struct<cf_bot_score:int,datadome_present:boolean,datadome_botname:string,datadome_ruletype:string,datadome_action:string,datadome_score:double>,
shape struct<request_bytes:bigint,header_count:int,header_bytes:int,cookie_count:int,cookie_names:array<string>,body_form:string>,
data_quality_flags array<string>, masked_fields array<string>, parse_error string
"""

DEAD_LETTER = "dead_letter_id string, tenant string, provider string, received_at timestamp, payload string, reason string, parser_version string, state string"
