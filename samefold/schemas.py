"""Schemas of the engine's tables. Text that is unknown is '', numbers that are unknown are null."""

ITEM = (
    "kind string, ref string, gtin string, brand string, mpn string, name_by_lang map<string,string>, attrs map<string,string>, "
    "image_path_or_url string, updated_at timestamp"
)
QUERY = (
    "query_id long, q string, ean string, brand string, mpn string, sku string, name string, "
    "attrs struct<weight:decimal(38,10),width:decimal(38,10),height:decimal(38,10),deep:decimal(38,10),color:string,size:string,pack_qty:int>, "
    "scope array<string>, limit int, image_url string, phash long, image_vec array<float>, model_id string"
)
IMAGE_COLUMNS = ["phash", "image_vec", "vec_model", "image_sha1"]
FINGERPRINT = (
    "kind string, ref string, gtin14 string, gtin_trusted boolean, brand_norm string, mpn_norm string, name_norm string, name_tokens array<string>, "
    "pack_qty int, color string, size string, weight decimal(12,4), width decimal(12,4), height decimal(12,4), deep decimal(12,4), "
    "phash long, image_vec array<float>, vec_model string, image_sha1 string, source_updated_at timestamp"
)
DECISION = (
    "query_id long, query string, subject_ref string, candidate_kind string, candidate_ref string, score int, "
    "features array<struct<code:string,label:string,score:int,observed:struct<query:string,candidate:string>>>, "
    "decision_auto string, decision_human string, user_id long, source string, created_at timestamp"
)
