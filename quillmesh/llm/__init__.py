"""quillmesh subpackage."""
