"""Incremental ingestion with Structured Streaming.

The reference has no stream processing; its segmentation and encoding
steps are row-local, so the same column expressions run unchanged on a
streaming DataFrame.  This module only wires them to ``readStream`` /
``writeStream`` for collections that grow over time.
"""
