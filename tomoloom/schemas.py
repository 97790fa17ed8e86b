"""Table shapes shared by the sources and operators (DDL strings)."""

VOXEL = "volume_id string, z int, y int, x int, v double"
# What the volume files yield: one row per line of voxels along x.
LINE = "volume_id string, z int, y int, run array<double>"
VOLUME_META = "volume_id string, nz int, ny int, nx int, dtype string"
TRIANGLE = (
    "mesh_id string, tri_id bigint, ax double, ay double, az double, "
    "bx double, by double, bz double, cx double, cy double, cz double"
)
JUNCTION = "graph_id string, junction_id bigint, x double, y double, z double"
STRUT = (
    "graph_id string, strut_id bigint, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"
)
WORD_BOX = (
    "doc_id bigint, page_no int, word_no int, x0 double, y0 double, x1 double, y1 double, word string"
)
# What follows a page's own key in a line of heat.
HEAT_LINE = "y int, runs array<struct<x: int, w: array<double>>>"
# Only `junctions[].position` is read; struts and cells are counted whatever they hold, hence VARIANT.
LATTICE_JSON = (
    "junctions array<struct<position: array<double>>>, struts array<variant>, unit_cells array<variant>"
)
