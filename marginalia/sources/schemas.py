"""Explicit schemas of the stored forms; ``item_idx`` carries the order lists have in files."""

CONTENT_ITEM = (
    "type string, text string, page_idx bigint, image_caption string, table_caption string, "
    "table_body string, img_path string, doc_title string, journal string, "
    "publication_year string, chunk_type string, section_tag string, evidence_level int, "
    "entities array<string>, one_liner string")
TABLE_DICT = ("num_rows int, num_cols int, "
              "table_cells array<struct<row:int,col:int,text:string>>")
ENTITY = "count bigint, create_time bigint, chunk_ids array<string>"
RELATION = ENTITY
DOC_STATUS = "status string, chunks_count bigint, content_length bigint, created_at string, file_path string"
CHUNKS = ("doc_name string, chunk_idx bigint, type string, page_idx bigint, text string, source string, "
          "content_md5 string, image_url string, vlm_analyzed boolean, section_tag string")
XML_NODE = "_id string, data array<struct<_key:string,_VALUE:string>>"
XML_EDGE = "_source string, _target string, data array<struct<_key:string,_VALUE:string>>"
XML_KEY = "_id string, _for string, `_attr.name` string, `_attr.type` string"
SEPARATOR = "<SEP>"
