"""Explicit schemas of every file the engine reads or writes."""

CHUNK = "id string, text string, title string, source string"
ENTITY = "title string, type string, description array<string>, text_unit_ids array<string>, frequency long"
RELATION = "source string, target string, description array<string>, text_unit_ids array<string>, weight double"
NODE = "id string, type string, description array<string>, text_unit_ids array<string>, frequency variant"
LINK = "source string, target string, weight double, description array<string>, text_unit_ids array<string>"
GRAPH = f"directed boolean, multigraph boolean, nodes array<struct<{NODE.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>, links array<struct<{LINK.replace(', ', ',').replace(' ', ':')}>>"
STEP = "weight double, description array<string>, text_unit_ids array<string>"
WALK = f"nodes array<string>, node_descriptions array<string>, chunk_ids array<string>, chunks_crossed int, edges array<struct<{STEP.replace(', ', ',').replace(' ', ':')}>>"
TURN = "conversations array<struct<`from`:string,value:string>>"
INTER = f"{TURN}, meta struct<type:string,walk_nodes:array<string>,chunk_ids:array<string>,chunks_crossed:int,target_node:string>"
INTRA = f"{TURN}, meta struct<type:string,chunk_id:string,title:string>"
