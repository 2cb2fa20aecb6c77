"""Column layouts of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L = T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


#: The product table at rest: nested values are JSON text.
PRODUCTS = _struct(
    camera_id=S, model_name=S, display_name=S, description=S, source=S, category=S, product_category=S, product_series=S,
    image_urls=S, image_files=S, datasheet_url=S, datasheet_file=S, specifications=S,
)
REQUIRED = ["camera_id", "model_name", "display_name", "source", "category", "product_category", "product_series"]
HIERARCHY = ["source", "product_category", "product_series"]

#: A product in a manifest tree, and the tree.
SPECS = T.MapType(S, T.MapType(S, S))
MANIFEST_PRODUCT = _struct(camera_id=S, model_name=S, image_urls=T.ArrayType(S), datasheet_url=S, specifications_html=SPECS)
MANIFEST = _struct(categories=T.MapType(S, _struct(series=T.MapType(S, _struct(products=T.ArrayType(MANIFEST_PRODUCT))))))

#: Vectors of catalog images; variant_tag may be absent.
VECTORS = _struct(row_id=L, camera_id=S, image_path=S, source=S, variant_tag=S, embedding=T.ArrayType(T.FloatType()))

#: Contents by URL, and product pages already extracted.
DOWNLOADS = _struct(url=S, content_hash=S, file_type=S, local_path=S, file_size_bytes=L, downloaded_at=T.TimestampType())
PRODUCT_CACHE = _struct(product_url=S, model_name=S, image_urls=S, datasheet_url=S, specifications_html=S)

#: One row per finding of the validation layers.
ISSUES = _struct(severity=S, type=S, field=S, path=S, cnt=L)

#: Stream frames.
FRAMES = _struct(client_id=S, ts=T.TimestampType(), frame_number=L, payload=T.BinaryType())
