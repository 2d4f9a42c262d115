"""Readers: XML publications, HTML pages, sitemaps, logs and registers."""
