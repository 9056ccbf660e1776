"""Writers: corpus tables, exports, rendered texts, index pages and reports."""
