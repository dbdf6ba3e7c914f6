"""culler: redundancy analysis and representative-subset selection over keyed
collections of items (test methods, code, documents, vectors), on Spark."""

__version__ = "0.1.0"
