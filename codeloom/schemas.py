"""Fixed schemas of the data model, as DDL."""

MODULE_KEY = "struct<module_source_type:int,id:string>"
SPAN = "struct<lineno:int,col:int,end_lineno:int,end_col:int>"
CONTEXT = "struct<kind:string,attribute:string,argc:int>"
VALUE = "struct<kind:string,type:string,value:string,name:string>"
PARAMETER = "struct<name:string,kind:string,hint:string,default:string>"

SYMBOL_ENTRIES = f"symbol_name string, symbol_type int, module_key {MODULE_KEY}, not_yet_found_in_module boolean, is_module_itself boolean, imported boolean, import_count bigint"
SYMBOL_ALIASES = f"as_name string, real_name string, module_key {MODULE_KEY}, is_module_itself boolean, import_count bigint"
TERMS = "term string, value bigint"
TREE = "prefix string, end_point boolean, value bigint, highest bigint, child_char string"
PATHS = "path string, is_dir boolean, value double"
FILE_HISTORY = "path string, ts double"
UPDATE_LOG = "timestamp timestamp, action_type string, data string, filename string"
IMPORT_REFS = f"importer {MODULE_KEY}, target {MODULE_KEY}, value string, as_name string"
MEMBERS = "owner_id bigint, owner_kind string, name string, value string"
REQUEST = "request_id string, command_id string, source string, filename string"
FAILED = "path string, error_kind string, message string"

#: Kinds of modules by number.
MODULE_SOURCE_TYPES = {0: "builtin", 1: "compiled", 2: "bad", 3: "normal"}
SYMBOL_TYPES = {0: "type", 1: "function", 2: "assignment", 3: "module", 4: "unknown", 5: "ambiguous"}
