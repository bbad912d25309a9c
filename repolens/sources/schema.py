"""Schemas of parsed files and of the tables of the code graph."""

from __future__ import annotations

FUNCTION = (
    "struct<name:string,line_number:int,end_line:int,args:array<string>,source:string,docstring:string,cyclomatic_complexity:int,context:string,"
    "class_context:string,decorators:array<string>,is_async:boolean,kind:string>"
)
CLASS = (
    "struct<name:string,line_number:int,end_line:int,bases:array<string>,implements:array<string>,source:string,docstring:string,"
    "is_abstract:boolean,is_interface:boolean>"
)
IMPORT = "struct<name:string,source:string,alias:string,line_number:int,is_default:boolean,is_namespace:boolean>"
CALL = (
    "struct<name:string,line_number:int,args:array<string>,caller_name:string,caller_line_number:int,full_call_name:string,inferred_obj_type:string>"
)
VARIABLE = "struct<name:string,line_number:int,value:string,type:string,context:string,class_context:string>"
PARSED_FILE = f"path string, lang string, functions array<{FUNCTION}>, classes array<{CLASS}>, imports array<{IMPORT}>, calls array<{CALL}>, variables array<{VARIABLE}>"

_SYMBOL = "id string, name string, path string, line_number int, end_line int"
_TEXT = "description string, described_hash string, embedding array<float>"
#: Node tables by label; ``id`` is the key of the label's natural key.
NODES = {
    "repositories": "path string, name string",
    "directories": f"path string, name string, repo_path string, {_TEXT}",
    "files": f"path string, name string, lang string, repo_path string, content_hash string, {_TEXT}",
    "functions": f"{_SYMBOL}, args array<string>, source string, docstring string, cyclomatic_complexity int, context string, class_context string, is_async boolean, kind string, decorators array<string>, lang string, repo_path string, {_TEXT}",
    "parameters": "name string, function_name string, path string, line_number int, repo_path string",
    "classes": f"{_SYMBOL}, bases array<string>, implements array<string>, source string, docstring string, is_abstract boolean, is_interface boolean, lang string, repo_path string, {_TEXT}",
    "variables": f"id string, name string, path string, line_number int, value string, type string, context string, class_context string, lang string, repo_path string, {_TEXT}",
    "modules": "name string",
}
#: Edge tables by type.
EDGES = {
    "contains_dir": "parent_path string, path string, repo_path string",
    "contains_file": "dir_path string, path string, repo_path string",
    "imports": "path string, module string, imported_name string, alias string, line_number int, is_default boolean, is_namespace boolean, repo_path string",
    "inherits": "src_id string, dst_id string, repo_path string",
    "implements": "src_id string, dst_id string, repo_path string",
    "calls": "src_id string, dst_id string, line_number int, repo_path string",
}
#: Calls as parsed, kept to link again when other files change.
BRONZE = {"parsed_calls": "path string, name string, line_number int, args array<string>, caller_name string, caller_line_number int, full_call_name string, inferred_obj_type string, repo_path string"}
TABLES = NODES | EDGES | BRONZE
#: Indexes over node tables, which a store keeps beside them: the words of symbols' names, sorted by word in each file, where a
#: row of the empty word stands for each symbol; and the nodes that have vectors, by cells around centroids.
INDEXES = {
    "name_postings": "term string, label string, labels array<string>, name string, path string, line_number long, tf long, length long",
    "vectors": "label string, node string, name string, path string, line_number long, description string, repo_path string, embedding array<float>, cell int",
    "centroids": "cell int, center array<float>, trained long, probes int",
}
#: Tables whose runs are kept in a folder for each value of a column, so that a search reads a few of them; the order of rows in others.
FOLDERS, ORDERS = {"vectors": "cell"}, {"name_postings": "term"}
LABELS = {"repositories": "Repository", "directories": "Directory", "files": "File", "functions": "Function", "classes": "Class", "variables": "Variable", "modules": "Module", "parameters": "Parameter"}
#: The natural key of each node table; unique after every write.
KEYS = {
    "repositories": ["path"], "directories": ["path"], "files": ["path"], "functions": ["name", "path", "line_number"],
    "classes": ["name", "path", "line_number"], "variables": ["name", "path", "line_number"], "modules": ["name"], "parameters": ["name", "function_name", "path"],
}
#: The column whose values a change of a table replaces as a whole; each natural key holds it.
UNITS = {
    "repositories": "path", "directories": "path", "files": "path", "functions": "path", "parameters": "path", "classes": "path", "variables": "path", "modules": "name",
    "contains_dir": "path", "contains_file": "path", "imports": "path", "inherits": "src_id", "implements": "src_id", "calls": "src_id", "parsed_calls": "path", "name_postings": "path",
    "vectors": "path", "centroids": "cell",
}
