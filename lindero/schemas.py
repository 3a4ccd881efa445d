"""Explicit schemas. JSON and file sources are never inferred."""

from __future__ import annotations

POINT = "struct<x:double,y:double>"
RING = f"array<{POINT}>"
RINGS = f"array<{RING}>"

COORDS = "rc14 string, x double, y double, address string"
PARCELS = f"refcat string, label string, area_m2 double, poly {RING}"
ZONES = f"id string, ficha_id string, categoria string, ficha_url string, rings {RINGS}, ord long"
SHEETS = "sheet_name string, url string"
FICHAS = "filename string, url string, tipo string, codigo string, num int, ord long"
UNITS = (
    "rc14 string, rc string, address string, floor string, door string, stair string, "
    "use string, area_m2 int, year int"
)
CALIBRATION = (
    "level string, key string, dx double, dy double, n long, std_x double, std_y double, "
    "residual_px double, direct boolean"
)
LABELS = (
    "rc string, action string, dx int, dy int, cal_dx int, cal_dy int, snap_score double, "
    "etiqueta string, seq long, ts timestamp"
)
MATCHES = "rc string, matches int, inliers int, raw_dx int, raw_dy int, has_model boolean"
TILES = "x1 int, y1 int, x2 int, y2 int, mpp double, bytes long, path string"

# Landed responses of the unit registry; both shapes of the record list are tried.
UNIT_RECORD = (
    "struct<rc:struct<pc1:string,pc2:string,car:string,cc1:string,cc2:string>,"
    "idbi:struct<rc:struct<pc1:string,pc2:string,car:string,cc1:string,cc2:string>>,"
    "dt:struct<nm:string,locs:struct<lous:struct<lourb:struct<"
    "dir:struct<tv:string,nv:string,pnp:string>,"
    "loint:struct<pt:string,pu:string,es:string>>>,"
    "lors:struct<lorus:struct<npa:string,cpp:struct<cpo:string,cpa:string>>>>>,"
    "debi:struct<luso:string,sfc:string,ant:string>>"
)
UNIT_RESPONSE = (
    "consulta_dnprcResult struct<lrcdnp:struct<rcdnp:string>,"
    f"bico:struct<bi:{UNIT_RECORD}>>"
)

# One parcel of a chunk file; vertices are [x, y] pairs.
CHUNK_PARCEL = (
    "array<struct<refcat:string,label:string,area_m2:double,poly_utm:array<array<double>>>>"
)

# A page of layer features; coordinates stay text until the geometry type is known.
FEATURE_PAGE = (
    "features array<struct<properties:map<string,string>,"
    "geometry:struct<type:string,coordinates:string>>>"
)
