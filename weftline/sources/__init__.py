"""Where data comes from and goes to: files of a project, seeds and catalog relations."""
