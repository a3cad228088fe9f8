"""Reading and writing of labelled dossiers, reports, exports and the two stores."""
